"""Transcripts, captions and metadata files, from a table of whole texts, as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.timefns import clock_to_seconds

# The forms of a stamped line and of a cue's times.
STAMPED = r"^\[(\d{2}:\d{2}:\d{2})\]\s*(.+)"
CUE = r"^(\d{2}:\d{2}:\d{2})\.\d{3} --> (\d{2}:\d{2}:\d{2})\.\d{3}"


def lines_of(files: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, line_no, raw)``, line numbers from 0; any of the usual line ends parts lines."""
    return files.select(ident, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "raw"))


def stamped_lines(files: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, line_no, seconds, text)`` of the lines that begin with a stamp; others are left out."""
    ln = lines_of(files, ident, text).filter(F.col("raw").rlike(STAMPED))
    return ln.select(ident, "line_no", clock_to_seconds(F.regexp_extract("raw", STAMPED, 1)).alias("seconds"), F.regexp_extract("raw", STAMPED, 2).alias("text"))


def sectioned_lines(files: DataFrame, ident: str, text: str, default: str = "General") -> DataFrame:
    """``(ident, line_no, section, seconds, text)``: stamped lines, the stamp anywhere, under the last ``## header``."""
    ln = lines_of(files, ident, text)
    head = F.when(F.col("raw").startswith("## "), F.trim(F.substr("raw", F.lit(4))))
    w = Window.partitionBy(ident).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ln = ln.withColumn("head", head).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(default)))
    found = r"\[(\d{2}:\d{2}:\d{2})\]"
    ln = ln.filter(F.col("head").isNull() & F.col("raw").rlike(found))
    return ln.select(ident, "line_no", "section", clock_to_seconds(F.regexp_extract("raw", found, 1)).alias("seconds"), F.trim(F.regexp_replace("raw", found, "")).alias("text"))


def cue_text(raw: Column) -> Column:
    """A caption line without inline stamps and tags, the common entities undone, single spaces."""
    s = F.regexp_replace(raw, r"<\d{2}:\d{2}:\d{2}\.\d{3}>|</?c[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def vtt_cues(files: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, seconds, text)`` of WEBVTT texts: one row per cue start, of several texts the longest, first on ties.

    Head lines, cue settings, cue numbers and blank lines carry no text.
    """
    ln = lines_of(files.filter(F.col(text).startswith("WEBVTT")), ident, text)
    w = Window.partitionBy(ident).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stamp = F.when(F.col("raw").rlike(CUE), F.regexp_extract("raw", CUE, 1))
    ln = ln.withColumn("stamp", stamp).withColumn("cue", F.max(F.when(F.col("stamp").isNotNull(), F.col("line_no"))).over(w)).withColumn("start", F.last("stamp", ignorenulls=True).over(w))
    body = ln.filter(F.col("start").isNotNull() & F.col("stamp").isNull() & ~F.col("raw").rlike(r"^\s*$|^(WEBVTT|Kind:|Language:|NOTE)|align:|position:|^\d+$"))
    body = body.withColumn("t", cue_text(F.col("raw"))).filter("t <> ''")
    cues = body.groupBy(ident, "cue", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ").alias("text"))
    best = cues.groupBy(ident, "start").agg(F.max_by("text", F.struct(F.length("text").alias("n"), (-F.col("cue")).alias("c"))).alias("text"))
    return best.select(ident, clock_to_seconds("start").alias("seconds"), "text")


def key_values(text: Column) -> Column:
    """A map of ``key: value`` lines; the last of equal keys counts."""
    pairs = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x.contains(":"))
    entry = F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(entry, lambda e: e["k"] != "")
    return F.map_from_entries(F.array_distinct(F.transform(last, lambda e: F.struct(e["k"].alias("k"), F.element_at(F.filter(last, lambda o: o["k"] == e["k"]), -1)["v"].alias("v")))))


def with_image_before(paragraphs: DataFrame, relations: DataFrame, doc: str, order: str, rid: str, text: str) -> DataFrame:
    """``(doc, order, text, image)`` of the paragraphs with text, each with the last image placed before it.

    relations: ``(doc, rid, media)`` of a document; a paragraph may place an image by its id, and an unknown id places none.
    """
    media = relations.select(F.col(doc), F.col(rid), F.col("media").alias("_media")).dropDuplicates([doc, rid])
    placed = paragraphs.join(media, [doc, rid], "left")
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("image", F.last("_media", ignorenulls=True).over(w))
    return placed.filter(F.coalesce(F.trim(text), F.lit("")) != "").select(doc, order, text, "image")


def playlist_entries(listings: DataFrame, ident: str, body: str) -> DataFrame:
    """``(ident, video, title)`` of the JSON of playlists, without entries that have no id; a listing without entries is
    one video."""
    entry = "struct<id:string,title:string>"
    got = listings.select(F.col(ident), F.from_json(body, f"struct<id:string,title:string,entries:array<{entry}>>").alias("l"))
    one = F.array(F.struct("l.id", "l.title")).cast(f"array<{entry}>")
    rows = got.select(ident, F.explode(F.when(F.col("l.entries").isNull(), one).otherwise(F.col("l.entries"))).alias("e")).filter("e.id is not null")
    return rows.select(ident, F.col("e.id").alias("video"), F.coalesce("e.title", F.lit("Unknown")).alias("title"))
