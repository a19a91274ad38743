"""Order-dependent operators: folds over the rows of a key in order.

A fold whose state is one row takes the sorted rows of a partition as they pass by; folds over the lines of one text
run inside the JVM, over its array. Where state must outlive a run, the streaming twins in ``quillstream.streaming`` keep it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_dedup(rows: DataFrame, key: str, order: list[str], ident: str, value: str, near: float) -> DataFrame:
    """``(key, ident, reference, is_duplicate)``: each row against the last row that was kept.

    A row within ``near`` of the reference's value is its duplicate; else it becomes the reference. A null value is
    always kept. What is kept depends on all rows before, so a key is one task's; it is sorted on disk if need be and
    passes by in batches, with one row as state.
    """
    ident_type, key_type = rows.schema[ident].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    put = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(ident).alias("_id"), F.col(value).cast("double").alias("_v"))
    put = put.repartition("_k").sortWithinPartitions("_k", *[f"_o{i}" for i in range(len(order))]).select("_k", "_id", "_v")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ref, last = object(), None, None
        for b in batches:
            out: tuple[list, list] = ([], [])
            for k, i, v in zip(*(b.column(c).to_pylist() for c in ("_k", "_id", "_v"))):
                if k != at:
                    at, ref, last = k, None, None
                dup = v is not None and last is not None and abs(v - last) <= near
                if not dup:
                    ref, last = i, v
                out[0].append(ref)
                out[1].append(dup)
            cols = [b.column("_k"), b.column("_id"), pa.array(out[0], b.schema.field("_id").type), pa.array(out[1], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, ident, "reference", "is_duplicate"])

    return put.mapInArrow(fold, f"`{key}` {key_type}, `{ident}` {ident_type}, reference {ident_type}, is_duplicate boolean")


def lookback(rows: DataFrame, order: str, ident: str, k: int, hit: Column, prefix: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``(ident, match)``: of the ``k`` rows before each, by a dense position, the earliest that ``hit`` accepts.

    rows has the position in ``order``; ``hit`` speaks of ``a.*`` (before) and ``b.*``. Positions are met by equality.
    """
    a, b = (rows.alias(p) for p in prefix)
    reach = b.withColumn("_p", F.explode(F.sequence(F.col(order) - k, F.col(order) - 1))).alias("b")
    hits = reach.join(a, F.col("b._p") == F.col(f"a.{order}")).filter(hit)
    found = hits.groupBy(F.col(f"b.{ident}").alias(ident)).agg(F.min_by(F.col(f"a.{ident}"), F.col(f"a.{order}")).alias("match"))
    return rows.select(ident).join(found, ident, "left")


def budget_prefix(rows: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The first rows of each key whose sizes together stay within the budget, with ``used`` up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def greedy_chunks(lines: Column, window: int) -> Column:
    """An array of lines as chunks of at most ``window`` characters, a line feed counted for each line before; a
    longer line is a chunk of its own. Chunks are their lines joined by line feeds."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("size"))

    def step(acc: Column, ln: Column) -> Column:
        full = acc["cur"].isNotNull() & (acc["size"] + F.length(ln) > window)
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        cur = F.when(full | acc["cur"].isNull(), ln).otherwise(F.concat(acc["cur"], F.lit("\n"), ln))
        size = F.when(full, F.lit(0)).otherwise(acc["size"]) + F.length(ln) + 1
        return F.struct(done.alias("done"), cur.alias("cur"), size.alias("size"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def fixed_chunks(text: Column, n: int) -> Column:
    """A text in pieces of n characters, the last one shorter; an empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text), F.lit(n)), lambda i: F.substr(text, i, F.lit(n))))


def sampled_sections(text: Column, over: int, part: int, sep: str = "\n...\n") -> Column:
    """Begin, middle and end of a text of more than ``over`` characters, ``part`` characters each; else the text."""
    n = F.length(text)
    mid = F.floor(n / 2).cast("int") - part // 2
    return F.when(n > over, F.concat_ws(sep, F.left(text, F.lit(part)), F.substr(text, mid + 1, F.lit(part)), F.right(text, F.lit(part)))).otherwise(text)
