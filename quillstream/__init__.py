"""quillstream: time-aligned media and knowledge analytics on PySpark."""

__version__ = "0.1.0"
