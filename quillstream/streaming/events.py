"""Streaming twins of the batch operators: buckets, duplicate suppression, folds with state, incremental runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_counts(stream: DataFrame, ts: str, keys: list[str], every: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """``(bucket, *keys, n)`` of tumbling windows; rows later than ``delay`` are left out."""
    w = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).groupBy(F.window("_ts", every).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.unix_micros("w.start").alias("bucket"), *keys, "n")


def first_within(stream: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Rows whose keys were not seen within the watermark's delay before them."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys)


def kept_references(stream: DataFrame, key: str, order: str, ident: str, value: str, near: float) -> DataFrame:
    """``(key, ident, reference, is_duplicate)``: each row against the last row of its key that was kept.

    The state of a key is the reference's id and value, for good; the rows of a key in one micro-batch are sorted in
    memory, so micro-batches are to be bounded (``files_per_batch``).
    """
    id_type, key_type = stream.schema[ident].dataType.simpleString(), stream.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ref, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values([order, ident])
        out = []
        for i, v in zip(rows[ident], rows[value]):
            dup = last is not None and v is not None and abs(v - last) <= near
            if not dup:
                ref, last = i, v
            out.append((k[0], i, ref, dup))
        state.update((ref, last))
        yield pd.DataFrame(out, columns=[key, ident, "reference", "is_duplicate"])

    return stream.select(key, order, ident, value).groupBy(key).applyInPandasWithState(
        fold, f"{key} {key_type}, {ident} {id_type}, reference {id_type}, is_duplicate boolean", f"ref {id_type}, last double", "append", GroupStateTimeout.NoTimeout)


def _last(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("r")).select(key, "r.*")


def upsert(path: str, key: str, at: str):
    """For ``foreachBatch``: add a batch's last row of each key to the table of :func:`upserted` below ``path``.

    A batch writes its own rows only, under its number, so a batch that is run again replaces itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        _last(batch, key, at).write.mode("overwrite").parquet(f"{path}/v{batch_id:06d}")

    return run


def upserted(spark: SparkSession, path: str, key: str, at: str) -> DataFrame:
    """The last row of each key of all batches so far."""
    return _last(spark.read.parquet(f"{path}/v*"), key, at)


def compact(spark: SparkSession, path: str, key: str, at: str, upto: int) -> None:
    """Put the batches up to a number into one, under that number, between runs of the stream."""
    older = [f"{path}/v{i:06d}" for i in range(upto + 1) if _there(spark, f"{path}/v{i:06d}")]
    joined = f"{path}/compacted"
    _last(spark.read.parquet(*older), key, at).write.mode("overwrite").parquet(joined)
    for p in older:
        _path(spark, p)[1].delete(_path(spark, p)[0], True)
    file, fs = _path(spark, joined)
    fs.rename(file, _path(spark, f"{path}/v{upto:06d}")[0])


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)
