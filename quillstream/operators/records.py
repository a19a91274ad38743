"""Typed records: checks, flattening, routing and merging of what a model returned for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.timefns import two_digits
from quillstream.schemas import INSTRUMENTS, KNOWLEDGE_TYPES, SESSIONS


def distinct_units(units: DataFrame) -> DataFrame:
    """One row per unit; rows delivered twice are equal."""
    return units.filter("unit_id is not null").dropDuplicates(["unit_id"])


def filled_payloads() -> Column:
    """Names of the payloads that are there, in their fixed order."""
    return F.filter(F.array(*[F.when(F.col(p).isNotNull(), F.lit(p)) for p in KNOWLEDGE_TYPES]), lambda x: x.isNotNull())


def violations() -> Column:
    """What is wrong with a unit: payloads not exactly one, payload of another type, confidence out of bounds,
    required text missing; an empty array if nothing is."""
    kind = F.col("metadata.knowledge_type")
    conf = F.col("metadata.extraction_confidence")
    rules = [
        (F.size(filled_payloads()) != 1, "payload_count"),
        ((F.size(filled_payloads()) == 1) & ~F.get(filled_payloads(), F.lit(0)).eqNullSafe(kind), "payload_type"),
        (conf.isNotNull() & ~conf.between(0.0, 1.0), "confidence_bounds"),
        (F.coalesce(F.col("summary"), F.lit("")) == "", "summary_missing"),
        (~F.coalesce(kind.isin(KNOWLEDGE_TYPES), F.lit(False)), "unknown_type"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())


def enum_list(values: Column, domain: list[str], default: str = "any") -> Column:
    """Members of the domain, in order and each once; ``[default]`` if none is left."""
    kept = F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isin(domain)))
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def payload_json() -> Column:
    """The first payload that is there, as JSON."""
    return F.coalesce(*[F.to_json(F.col(p)) for p in KNOWLEDGE_TYPES])


def payload_label() -> Column:
    """The leading text of the first payload that is there."""
    lead = {"setup": "name", "contextual": "event_or_condition", "framework": "method_name", "tip": "heuristic", "psychology": "principle", "anecdote": "embedded_heuristic"}
    return reduce(lambda rest, p: F.when(F.col(p).isNotNull(), F.col(f"{p}.{lead[p]}")).otherwise(rest), reversed(KNOWLEDGE_TYPES), F.lit(None).cast("string"))


def retrieval_text(raw_fallback: bool) -> Column:
    """Text to search a unit by: summary, concepts and leading payload text, each on its own line.

    With raw_fallback, the concepts as typed stand in where no canonical ones are known.
    """
    canon, raw = F.col("metadata.concepts_canonical"), F.col("metadata.concepts_raw")
    use = F.when(F.coalesce(F.size(canon), F.lit(0)) > 0, canon).otherwise(raw) if raw_fallback else canon
    return F.concat_ws("\n", "summary", F.nullif(F.array_join(use, ", "), F.lit("")), payload_label())


def flatten_units(units: DataFrame) -> DataFrame:
    """The search table: scalars of a unit, its lists as arrays and joined by commas, nulls of text as ``''``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return units.select(
        "unit_id", "summary", text("verbatim_anchor").alias("verbatim_anchor"), F.col("metadata.knowledge_type").alias("knowledge_type"),
        F.col("metadata.testability").alias("testability"), F.coalesce("metadata.extraction_confidence", F.lit(0.0)).alias("confidence"),
        F.array_join(F.col("metadata.session_applicability"), ",").alias("sessions"), F.array_join(F.col("metadata.instrument_applicability"), ",").alias("instruments"),
        F.array_join(F.col("metadata.concepts_canonical"), ",").alias("concepts"), F.array_join(F.col("metadata.domains"), ",").alias("domains"),
        F.col("provenance.source_file").alias("source_file"), F.col("provenance.source_type").alias("source_type"), text("provenance.session_date").alias("session_date"),
        text("provenance.speaker").alias("speaker"), F.col("provenance.chunk_id").alias("chunk_id"), text("provenance.timestamp_range").alias("timestamp_range"))


def prefilter(knowledge_type: str | None = None, session: str | None = None, testability: str | None = None, min_confidence: float | None = None, source_type: str | None = None) -> Column:
    """Metadata conditions of a search, those given all together; a session also takes units for any session, and a
    confidence of 0 filters nothing."""
    m = "metadata."
    parts = [
        F.col(m + "knowledge_type") == knowledge_type if knowledge_type else None,
        F.array_contains(m + "session_applicability", session) | F.array_contains(m + "session_applicability", "any") if session else None,
        F.col(m + "testability") == testability if testability else None,
        F.col(m + "extraction_confidence") >= min_confidence if min_confidence else None,
        F.col("provenance.source_type") == source_type if source_type else None,
    ]
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def sanitised(units: DataFrame) -> DataFrame:
    return units.select("unit_id", enum_list(F.col("metadata.session_applicability"), SESSIONS).alias("sessions"), enum_list(F.col("metadata.instrument_applicability"), INSTRUMENTS).alias("instruments"))


def unit_id(stem: Column, chunk: Column, ordinal: Column) -> Column:
    """``<stem>__<chunk>_<ordinal>_<ten digits of sha1 of stem:chunk:ordinal>``."""
    return F.concat(stem, F.lit("__"), two_digits(chunk), F.lit("_"), two_digits(ordinal), F.lit("_"), F.left(F.sha1(F.concat_ws(":", stem, chunk.cast("string"), ordinal.cast("string"))), F.lit(10)))


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Rows with ``batch`` and ``in_batch``, both from 0, in the order of each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("in_batch", (F.col("_n") % size).cast("int")).drop("_n")


def merge_batch(asked: DataFrame, answers: DataFrame, keys: list[str], idx: str, pos: str, value: str) -> DataFrame:
    """Asked rows with the answer of their index, the last one if several came; null where none did."""
    last = answers.filter(F.col(idx).isNotNull()).groupBy(*keys, idx).agg(F.max_by(value, pos).alias(value))
    return asked.join(last, [*keys, idx], "left")


def json_object(text: Column) -> Column:
    """The outermost ``{...}`` of a model's answer, without thinking and code fences; null if there is none."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)
    s = F.when(fenced != "", F.trim(fenced)).otherwise(F.trim(F.regexp_replace(s, r"```(?:json)?", "")))
    inner = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    single = F.regexp_extract(s, r"(?s)^\[\s*(\{.*\})\s*\]$", 1)
    return F.nullif(F.when(s.startswith("["), single).otherwise(inner), F.lit(""))


def reading_units(readings: DataFrame) -> DataFrame:
    """Units from readings of images: ``(stem, is_method, name, framework, inferred, mechanics)`` to ``(stem,
    knowledge_type, testability, confidence, summary, entry, answers)``.

    A method becomes a setup, whose entry is its mechanics one after the other; any other page a framework, named after
    the framework unless that is ``other``, which answers its first two inferred points.
    """
    named = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    method, text = F.coalesce(F.col("is_method"), F.lit(False)), lambda c: F.coalesce(c, F.lit(""))
    lines = F.transform("mechanics", lambda m: F.concat(text(m["name"]), F.lit(": "), text(m["description"]), F.lit(" (Risk: "), text(m["risk_reward"]), F.lit(")")))
    framed = named("framework").isNotNull() & (F.col("framework") != "other")
    page = F.when(framed, F.concat("framework", F.lit(" reference: "), "stem")).otherwise(F.coalesce(named("name"), F.concat(F.lit("Reference page: "), "stem")))
    return readings.select(
        "stem", F.when(method, "setup").otherwise("framework").alias("knowledge_type"), F.when(method, "partially").otherwise("not_testable").alias("testability"),
        F.when(method, 0.7).otherwise(0.6).alias("confidence"), F.when(method, F.coalesce(named("name"), F.concat(F.lit("Chart setup: "), "stem"))).otherwise(page).alias("summary"),
        F.when(method, F.nullif(F.array_join(lines, "; "), F.lit(""))).alias("entry"), F.when(~method, F.nullif(F.array_join(F.slice("inferred", 1, 2), "; "), F.lit(""))).alias("answers"))


def committed(reviews: DataFrame, status: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Approved reviews, parted into units and journal records; others are left out."""
    ok = reviews.filter(F.col(status) == "approved")
    return ok.filter(F.coalesce(F.col(target) != "journal", F.lit(True))), ok.filter(F.col(target) == "journal")
