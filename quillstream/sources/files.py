"""Scans of folders, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators.sizes import small_side

MEDIA = ["mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v", "mp3", "wav", "m4a", "aac", "flac", "ogg"]


def jsonl_units(spark: SparkSession, dirs: list[str], schema: str, key: str | None = None) -> DataFrame:
    """Records of one JSON object per line from several folders; blank lines are skipped.

    With ``key``, of records of equal key the one of the last file and line counts.
    """
    lines = spark.read.text(dirs, pathGlobFilter="*.jsonl", recursiveFileLookup=True).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema)).filter("r is not null")
    if key:
        last = Window.partitionBy(f"r.{key}").orderBy(F.desc("file_path"), F.desc("file_block_start"), F.desc("n"))
        rows = rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    return rows.select("r.*")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, without files named ``_...`` and records that report an error."""
    df = spark.read.schema(schema + ", error string, raw string").json(path, multiLine=True).withColumn("_name", F.col("_metadata.file_name"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.filter(~F.col("_name").startswith("_") & empty("error") & empty("raw")).drop("error", "raw", "_name")


def text_corpus(spark: SparkSession, path: str, glob: str = "*", max_files: int | None = None) -> DataFrame:
    """``(name, text)`` of whole files; with max_files the first ones by name."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return df.orderBy("name").limit(max_files) if max_files else df


def listing(spark: SparkSession, path: str, extensions: list[str], excluded: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """``(path, name, length, modified)`` of files by extension, in any case; no content is read.

    Paths with an excluded folder name are left out.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    df = df.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    df = df.filter(F.lower(F.substring_index("name", ".", -1)).isin([e.lower() for e in extensions]))
    for x in excluded or []:
        df = df.filter(~F.col("path").contains(f"/{x}/"))
    return df.distinct()


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """``(name, text)`` of files of unknown encoding: UTF-8, else UTF-16 by its mark, else Latin-1, which reads any bytes,
    so that no further encoding would ever be tried."""
    df = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).when(F.expr("is_valid_utf8(cast(content as string))"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return df.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), text.alias("text"))


def first_choice(candidates: DataFrame, preferences: DataFrame, key: str, kind: str, rank: str) -> DataFrame:
    """Of the candidates of a key, the one whose kind ranks first."""
    return candidates.join(small_side(preferences), kind).groupBy(key).agg(F.min_by(F.struct(*candidates.columns), F.col(rank)).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table; readers of the old one fail rather than mix."""
    df.write.mode("overwrite").parquet(path)


def write_by_status(df: DataFrame, path: str, status: str = "status") -> None:
    """One folder for each status, with the rows of a status together before writing."""
    df.repartition(status, F.pmod(F.xxhash64(*[c for c in df.columns if c != status]), F.lit(16))).write.mode("overwrite").partitionBy(status).parquet(path)


def write_versioned(df: DataFrame, path: str, version: int, dry_run: bool = False) -> str:
    """A new version beside the old ones; returns where it is, or with dry_run only where it would be."""
    at = f"{path}/v{version:06d}"
    if dry_run:
        return at
    df.write.mode("errorifexists").parquet(at)
    return at


def write_gated(units: DataFrame, path: str, confidence: str, least: float = 0.35) -> None:
    """Units over the confidence gate, and the held back beside them."""
    ok = F.coalesce(F.col(confidence), F.lit(0.0)) >= least
    write_jsonl(units.filter(ok), f"{path}/kept")
    write_jsonl(units.filter(~ok), f"{path}/held_back")
