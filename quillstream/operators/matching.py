"""Best match of a name among titles. Every name is held against every title, in blocks of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import indel_ratio_udf, match_name, sorted_tokens
from quillstream.operators.sizes import small_side

#: Titles of a block.
BLOCK = 1000


def _in_blocks(names: DataFrame, titles: DataFrame, keep: Column) -> DataFrame:
    """``names.*`` with each title ``t`` of ``titles(t)`` that ``keep`` accepts, as a struct ``t``.

    A row meets a block of titles, not a title; what is not kept never becomes a row.
    """
    blocks = titles.groupBy(F.pmod(F.xxhash64("t"), F.lit(max(1, -(-titles.count() // BLOCK)))).alias("_b")).agg(F.collect_list("t").alias("_ts"))
    met = names.crossJoin(small_side(blocks.drop("_b")))
    return met.select(*names.columns, F.explode(F.filter("_ts", keep)).alias("t"))


def best_title(names: DataFrame, titles: DataFrame, name: str, title: str, order: str, threshold: float = 70.0) -> DataFrame:
    """``(name, title, score)``: the title of the highest token-sort ratio, the first by ``order`` on ties; null where
    none reaches the threshold.

    A ratio of r per cent allows (1 - r / 100) times both lengths of insertions and deletions, which are never fewer than
    the Levenshtein distance; pairs beyond that are left out in the JVM, and no pair that reaches the threshold.
    """
    a = names.select(F.col(name).alias("a")).distinct().withColumn("ka", sorted_tokens(match_name("a")))
    b = titles.select(F.struct(F.col(title).alias("b"), F.col(order).alias("o"), sorted_tokens(match_name(title)).alias("kb")).alias("t"))

    def may(t: Column) -> Column:
        room = (F.length("ka") + F.length(t["kb"])) * (1 - threshold / 100) + 1e-6
        return (F.abs(F.length("ka") - F.length(t["kb"])) <= room) & (F.levenshtein(F.col("ka"), t["kb"]) <= room)

    scored = _in_blocks(a, b, may).withColumn("score", indel_ratio_udf("ka", "t.kb")).filter(F.col("score") >= threshold)
    best = scored.groupBy("a").agg(F.max_by(F.struct("t.b", "score"), F.struct("score", (-F.col("t.o")).alias("o"))).alias("m"))
    return a.select("a").join(best, "a", "left").select(F.col("a").alias(name), F.col("m.b").alias(title), F.col("m.score").alias("score"))


def nearest_title(names: DataFrame, titles: DataFrame, name: str, title: str) -> DataFrame:
    """``(name, title, dist)``: the title of the least Levenshtein distance, the first in order on ties."""
    a = names.select(F.col(name).alias("a")).filter("a is not null").distinct()
    b = titles.select(F.struct(F.col(title).alias("b")).alias("t")).filter("t.b is not null").distinct()
    blocks = b.groupBy(F.pmod(F.xxhash64("t"), F.lit(max(1, -(-b.count() // BLOCK)))).alias("_b")).agg(F.collect_list("t").alias("_ts"))
    met = a.crossJoin(small_side(blocks.drop("_b")))
    near = F.array_min(F.transform("_ts", lambda t: F.struct(F.levenshtein(F.col("a"), t["b"]).alias("dist"), t["b"].alias("b"))))
    best = met.select("a", near.alias("m")).groupBy("a").agg(F.min("m").alias("m"))
    return best.select(F.col("a").alias(name), F.col("m.b").alias(title), F.col("m.dist").alias("dist"))
