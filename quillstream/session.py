"""Session factory and the shared scratch space of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillstream", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; on a cluster use the session at hand."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the workers of a session, once, so that they need no path of their own to it.

    The archive is made beside the driver, and Spark's own file server gives it to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quillstream-code-")) / "quillstream.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without the setting: it then gets a folder of its own. On a cluster a missing
    setting is an error, as a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillstream-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_roots: list[str] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of all queries so far, for a caller that has taken their results."""
    while _roots:
        _delete(spark, _roots.pop())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written below :func:`shared_dir`; they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _roots.append(self.root)
        self._n = 0

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def cut(self, df: DataFrame, name: str = "t", tidy: bool = False) -> DataFrame:
        """Write ``df`` and read it back, so that later steps start from the files. If ``tidy``, the shuffle files of the
        write are deleted as it ends, not when the driver happens to collect its garbage."""
        at = self.path(name)
        before = self.spark.conf.get(_TIDY, "false")
        try:
            if tidy:
                self.spark.conf.set(_TIDY, "true")
            df.write.parquet(at)
        finally:
            self.spark.conf.set(_TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        if at := getattr(df, "_scratch_path", None):
            self.delete(at)

    def delete(self, at: str) -> None:
        """Delete a path below the folder."""
        _delete(self.spark, at)
