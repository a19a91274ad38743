"""Transcripts in pieces for a model: overlapping chunks, line groups, paragraphs; and checks of what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as tx

STAMP = r"\[(\d{1,2}:\d{2}(?::\d{2})?)\]"


def overlapping_chunks(lines: Column, size: int, carry: int = 3) -> Column:
    """Lines as chunks of at most ``size`` characters, line feeds counted, each beginning with the last ``carry``
    lines of the one before: ``array<struct<text, start_ts, end_ts>>``.

    The stamps are the last ones before a chunk's own lines and within them; a text that fits has one chunk, ``full``.
    A chunk is never only what it carried over: a line that doesn't fit beside it still enters.
    """
    stamp = lambda ln: F.nullif(F.regexp_extract(ln, STAMP, 1), F.lit(""))
    first = F.coalesce(F.get(F.filter(F.transform(lines, stamp), lambda s: s.isNotNull()), F.lit(0)), F.lit("00:00"))
    empty = F.array().cast("array<string>")
    chunk = lambda text, a, b: F.struct(text.alias("text"), a.alias("start_ts"), b.alias("end_ts"))
    none = F.array().cast("array<struct<text:string,start_ts:string,end_ts:string>>")
    start = F.struct(none.alias("done"), empty.alias("cur"), F.lit(0).alias("n"), first.alias("from"), first.alias("last"))
    width = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x) + 1)

    def step(acc: Column, ln: Column) -> Column:
        last = F.coalesce(stamp(ln), acc["last"])
        full = (acc["n"] + F.length(ln) + 1 > size) & (F.size(acc["cur"]) > 0)
        kept = F.when(F.size(acc["cur"]) > carry, F.slice(acc["cur"], -carry, carry)).otherwise(acc["cur"])
        done = F.when(full, F.concat(acc["done"], F.array(chunk(F.array_join(acc["cur"], "\n"), acc["from"], last)))).otherwise(acc["done"])
        cur = F.concat(F.when(full, kept).otherwise(acc["cur"]), F.array(ln))
        return F.struct(done.alias("done"), cur.alias("cur"), F.when(full, width(cur)).otherwise(acc["n"] + F.length(ln) + 1).alias("n"),
                        F.when(full, last).otherwise(acc["from"]).alias("from"), last.alias("last"))

    def end(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(chunk(F.array_join(acc["cur"], "\n"), acc["from"], acc["last"])))

    made = F.aggregate(lines, start, step, end)
    whole = F.array(chunk(F.array_join(lines, "\n"), F.lit("00:00"), F.lit("end")))
    return F.when((F.size(made) > 1) & (width(lines) - 1 >= size), made).otherwise(whole)


def line_groups(lines: DataFrame, ident: str, order: str, text: str, groups: int) -> DataFrame:
    """``(ident, part, text)``: lines joined in about ``groups`` parts of equal line counts."""
    n = lines.groupBy(ident).agg(F.count("*").alias("_n"))
    part = F.floor(F.col(order) / F.greatest(F.lit(1), F.floor(F.col("_n") / groups)))
    return lines.join(n, ident).groupBy(ident, part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def paragraphs(sentences: Column, most: int = 4, long: int = 200) -> Column:
    """An array of sentences as paragraphs that end after ``most`` of them, or after one over ``long`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        cur = F.concat(acc["cur"], F.array(s))
        full = (F.size(cur) >= most) | (F.length(s) > long)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(F.array_join(cur, " ")))).otherwise(acc["done"]).alias("done"),
                        F.when(full, F.array().cast("array<string>")).otherwise(cur).alias("cur"))

    return F.aggregate(sentences, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"]))


def trim_overlaps(lines: Column, least: int = 10) -> Column:
    """Caption lines without what each repeats of the line before it, by one fold over the array.

    Each line is seen against the last one that brought anything, taken whole. What lies within that one is left out; a
    line around that one takes its place; else the longest end of that one, of at least ``least`` characters, with which
    the line begins is cut off it. Empty lines are left out.
    """
    start = F.struct(F.lit("").alias("whole"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        whole, kept = acc["whole"], acc["kept"]
        around = line.contains(whole)
        room = F.least(F.length(whole), F.length(line))
        # Where the least beginning is not to be found, no longer one is; most lines end here.
        may = (room >= least) & whole.contains(F.left(line, F.lit(least)))
        shared = F.filter(F.when(may, F.sequence(F.lit(least), room)).otherwise(F.array().cast("array<int>")), lambda n: F.right(whole, n) == F.left(line, n))
        new = F.when(around, line).otherwise(F.trim(F.substr(line, F.coalesce(F.array_max(shared), F.lit(0)) + 1)))
        brings = ~whole.contains(line) & (new != "")
        before = F.when(around & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.struct(F.when(brings, line).otherwise(whole).alias("whole"), F.when(brings, F.concat(before, F.array(new))).otherwise(kept).alias("kept"))

    return F.aggregate(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), start, step, lambda acc: acc["kept"])


def _first_of_each(items: Column) -> Column:
    """Texts once each, case aside, the first kept: sorted with their places, compared with their neighbours, sorted back."""
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    # As the one element of an array the sorted texts are made once.
    first = F.flatten(F.transform(F.array(placed), lambda a: F.filter(a, lambda e, k: (k == 0) | (F.get(a, k - 1)["low"] != e["low"]))))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def clean_transcript(text: Column) -> Column:
    """A caption file as paragraphs, a blank line between them: lines stripped of stamps and noise, without overlaps;
    sentences of three characters or more, once each and without junk; contractions, fillers and first letters mended."""
    lines = trim_overlaps(F.transform(F.split(text, "\n"), lambda x: tx.strip_caption(x)))
    parts = F.filter(tx.sentences(F.array_join(lines, " ")), lambda s: (F.length(s) >= 3) & ~tx.is_junk(s))
    mended = F.transform(_first_of_each(parts), lambda s: tx.capitalise(tx.drop_leading_filler(tx.fix_contractions(s))))
    return F.array_join(paragraphs(mended), "\n\n")


def collapsed(chars: Column, segments: Column, long: int = 15000, per: int = 8000) -> Column:
    """Whether a long text came back in too few segments and is to be cut again by size."""
    return (chars > long) & (segments < F.greatest(F.lit(4), F.floor(chars / per)))


def complete_output(text: Column, least_bytes: int = 50) -> Column:
    """Whether a JSONL output is whole: long enough, and its last line parses."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce((F.octet_length(text) >= least_bytes) & F.try_parse_json(F.get(lines, F.size(lines) - 1)).isNotNull(), F.lit(False))


def complete_notes(text: Column, least_bytes: int = 1000) -> Column:
    """Whether notes are whole: long enough, and no ERROR near their begin."""
    return F.coalesce((F.octet_length(text) >= least_bytes) & ~F.left(text, F.lit(200)).contains("ERROR"), F.lit(False))


def coordinates(text: Column) -> Column:
    """``array<int>`` of the first four numbers of a free answer, x1, y1, x2, y2; null if there are fewer."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int"))
    return F.when(F.size(n) >= 4, F.slice(n, 1, 4))
