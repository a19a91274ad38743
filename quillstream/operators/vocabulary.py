"""A controlled vocabulary: aliases found inside raw phrases, and reports on what it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.sizes import small_side


def alias_index(vocabulary: DataFrame) -> DataFrame:
    """``(alias, cid)``: labels and aliases in lower case, each once."""
    names = vocabulary.select("cid", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return names.select(F.lower("alias").alias("alias"), "cid").filter("alias is not null and alias <> ''").distinct()


def contained(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """``(phrase, cid, alias)`` of every alias that occurs within a phrase (lower case), by keys of three characters.

    An alias occurs where its first characters do, so each position of a distinct phrase looks up the aliases that
    begin there; aliases shorter than three characters are looked up by what they are.
    """
    low = phrases.select("phrase").distinct().withColumn("low", F.lower("phrase")).filter("low <> ''")
    n = F.least(F.length("alias"), F.lit(3))
    keyed = index.withColumn("k", F.left(F.col("alias"), n)).withColumn("kn", n)
    at = low.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("low"))))
    at = at.withColumn("kn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("k", F.substr("low", F.col("i"), F.col("kn")))
    at = at.filter("length(k) = kn")
    # Keys of few characters are in most phrases, so the positions stay where they are if the index is small.
    met = at.join(small_side(keyed), ["k", "kn"]).filter(F.substr("low", F.col("i"), F.length("alias")) == F.col("alias"))
    return met.select("phrase", "cid", "alias").distinct()


def canonicalise(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(unit_id, concepts)``: the ids of all aliases in the raw phrases of a unit, longer aliases of a phrase
    first, each id once; an empty array where none is."""
    raw = units.select("unit_id", F.posexplode("metadata.concepts_raw").alias("pos", "phrase"))
    hits = contained(raw.filter("phrase is not null"), alias_index(vocabulary))
    found = raw.join(hits, "phrase").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.length("alias")).alias("n"), "alias", "cid"))).alias("a"))
    found = found.select("unit_id", F.array_distinct(F.transform("a", lambda s: s["cid"])).alias("concepts"))
    return units.select("unit_id").join(found, "unit_id", "left").select("unit_id", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))


def concept_counts(units: DataFrame) -> DataFrame:
    """``(concept, n, files, setups)`` of the raw phrases, trimmed and in lower case."""
    c = units.select(F.explode("metadata.concepts_raw").alias("raw"), F.col("provenance.source_file").alias("file"), F.col("metadata.knowledge_type").alias("kind"))
    c = c.withColumn("concept", F.lower(F.trim("raw")))
    return c.filter("concept <> ''").groupBy("concept").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.count_if(F.col("kind") == "setup").alias("setups"))


def unmapped(units: DataFrame, vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """``(concept, n)`` of phrases that contain no alias and occur at least ``least`` times."""
    counts = concept_counts(units)
    hits = contained(counts.select(F.col("concept").alias("phrase")), alias_index(vocabulary)).select(F.col("phrase").alias("concept")).distinct()
    return counts.join(hits, "concept", "left_anti").filter(F.col("n") >= least).select("concept", "n")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(unit_id, gained, lost)`` of units in both, from ``(unit_id, concepts)``."""
    j = before.select("unit_id", F.coalesce("concepts", F.array().cast("array<string>")).alias("old")).join(after.select("unit_id", F.col("concepts").alias("new")), "unit_id")
    return j.select("unit_id", F.array_except("new", "old").alias("gained"), F.array_except("old", "new").alias("lost"))


def top(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their percentage of the total; one row for each value that was counted."""
    return counts.withColumn("pct", F.round(F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy()), 4))
