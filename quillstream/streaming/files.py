"""Tables on disk as streams, and runs of a stream until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillstream.session import Scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, a file or a folder, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, the path may be a single file, too.
    return reader.parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def run_to_end(stream: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is and return what it appended."""
    out, state = scratch.path(name), scratch.path(f"{name}-state")
    resume(stream, out, state, mode)
    return read_sink(stream.sparkSession, out, stream.schema)


def resume(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Start, or start again from the same state, and wait until the present input is used up."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def read_sink(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(out)
