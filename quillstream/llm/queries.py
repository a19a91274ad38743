"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import p1_tensor, p2_components, p3_canonical, p4_nearest, p5_split, p6_encode, p8_stuffing
from quillstream.llm.p7_mix import Mix
from quillstream.llm.sql import SQL
from quillstream.sources.tables import table

TEXTS = ["summary", "verbatim_anchor"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p1_tensor.similar_pairs(table(spark, d, "knowledge_units"), "unit_id", TEXTS)
    return pairs.select(F.col("id_a").alias("unit_id_a"), F.col("id_b").alias("unit_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return p1_tensor.similar_groups(table(spark, d, "knowledge_units"), "unit_id", TEXTS).withColumnRenamed("id", "unit_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_components.duplicate_groups(table(spark, d, "duplicates"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_canonical.map_concepts(table(spark, d, "knowledge_units"), table(spark, d, "vocabulary"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return p3_canonical.unmatched_phrases(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = p4_nearest.entries_to_slides(spark, d).filter("right_id is not null")
    return found.select(F.col("left_id").alias("entry_id"), F.col("right_id").alias("slide_id"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    found = p4_nearest.entries_to_slides(spark, d).filter("right_id is null")
    return found.select(F.col("left_id").alias("entry_id"), F.col("entity").alias("video_id"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return p5_split.split_items(table(spark, d, "transcript_files"), table(spark, d, "pipeline_config"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the splitter cut: those of more than one piece, by their first."""
    return _pieces(spark, d).filter("n_pieces > 1 and piece_no = 0").select("file_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return p6_encode.encode_corpus(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return p6_encode.decode_corpus(p6_encode.encode_corpus(table(spark, d, "documents")))


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).placements()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_shard_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shard_quotas()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stuffing.stuffed_pages(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return p8_stuffing.score_stuffing(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_by_compression(spark: SparkSession, d: str) -> DataFrame:
    """What compression ratio and sentence ends report alone, to be held against p8_found."""
    scores = p8_stuffing.score_stuffing(table(spark, d, "documents"))
    return scores.filter("by_compression").select(F.col("id").alias("doc_id")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_groups, p2_found, p3_found, p3_unmatched, p4_found, p4_unmatched, p5_found, p5_pieces, p6_ids, p6_decoded,
        p7_mix, p7_shares, p7_shard_quotas, p8_found, p8_scores, p8_by_compression)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
