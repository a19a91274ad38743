"""Problem 5: splitting oversized items at natural boundaries.

Method: balanced targets. The least piece count that limit and target allow gives equal-length targets; each target
is snapped to the strongest boundary near it (a heading, a blank line, a line end, a sentence end, white space);
if a piece is over its limit, pieces are added and all are placed anew. Each piece then repeats the last lines of
the piece before it, as many as its limit leaves room for.

The parts without the repeated lines follow each other without gap, so together they are the item.

Defined results: lengths are code points; items that are not over their limit, or have none (no profile, a null or
non-positive limit), are one piece, an empty item one empty piece; null items have none; rows equal in id, profile
and text count once; a text without any boundary is cut at the targets, never inside a line end or before a mark
that combines with the character before it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.sizes import small_side

# Strongest first; a piece begins where the match ends.
_BOUNDARIES = [
    re.compile(r"(?:\r\n|\n|\r)+(?=#{1,6}\s)"),
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:(?:\r\n|\n|\r)[ \t]*)+"),
    re.compile(r"\r\n|\n|\r|\u2028|\u2029|\x85"),
    re.compile(r"[.!?…。！？][\"'”’)\]]*\s+"),
    re.compile(r"\s+"),
]
_LINE = re.compile(r"\r\n|\n|\r|\u2028|\u2029|\x85")
REACH = 0.3


def _hard(text: str, at: int) -> int:
    """The place nearest before ``at`` where a cut parts no line end and no combined character."""
    n = at
    while n > 1 and (text[n - 1 : n + 1] == "\r\n" or unicodedata.combining(text[n : n + 1] or " ") or text[n : n + 1] in ("\u200d", "\ufe0f") or text[n - 1] == "\u200d"):
        n -= 1
    return n if n > 1 else at


def _placed(text: str, n: int, ends: list[list[int]]) -> list[int]:
    """Begins of n pieces, each target snapped to the strongest boundary in its reach."""
    size = len(text)
    reach = REACH * size / n
    out = [0]
    for i in range(1, n):
        target = size * i / n
        low, high = max(target - reach, out[-1] + 1), min(target + reach, size - 1)
        for found in ends:
            a, b = bisect_left(found, low), bisect_right(found, high)
            if a < b:
                k = bisect_left(found, target, a, b)
                out.append(min((found[j] for j in (k - 1, k) if a <= j < b), key=lambda p: abs(p - target)))
                break
        else:
            cut = _hard(text, int(target))
            if out[-1] < cut < size:
                out.append(cut)
    return out


def split_text(text: str, target: int, limit: int, overlap_lines: int) -> list[tuple[int, int, int]]:
    """``(from, begin, end)`` of each piece: it is text[from:end], of which text[from:begin] repeats the one before."""
    size = len(text)
    if size <= limit:
        return [(0, 0, size)]
    target = max(1, min(target, limit))
    ends = [[m.end() for m in b.finditer(text)] for b in _BOUNDARIES]
    n = max(-(-size // limit), round(size / target), 2)
    while True:
        begins = _placed(text, n, ends) if n < size else list(range(size))
        bounds = [*begins, size]
        if all(b - a <= limit for a, b in zip(bounds, bounds[1:])):
            break
        n = max(n + 1, n + n // 50)
    lines = [0, *(m.end() for m in _LINE.finditer(text))]
    out = [(0, 0, bounds[1])]
    for begin, end in zip(bounds[1:], bounds[2:]):
        first = begin
        if overlap_lines > 0:
            # Begins of the last lines of the piece before; its own begin starts a line as well.
            last = bisect_left(lines, begin)
            starts = [p for p in reversed(lines[max(0, last - overlap_lines) : last]) if p > out[-1][0]]
            if len(starts) < overlap_lines:
                starts.append(out[-1][0])
            for p in starts:
                if end - p > limit:
                    break
                first = p
        out.append((first, begin, end))
    return out


_PIECE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("piece_no", "begin", "end", "overlap_chars")] + [T.StructField("piece", T.StringType())])


@F.pandas_udf(T.ArrayType(_PIECE))
def _pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, targets, limits, overlaps in batches:
        out = []
        for text, target, limit, overlap in zip(texts, targets, limits, overlaps):
            if text is None:
                out.append(None)
                continue
            cuts = split_text(text, int(target), int(limit), int(overlap))
            out.append([{"piece_no": i, "begin": b, "end": e, "overlap_chars": b - a, "piece": text[a:e]} for i, (a, b, e) in enumerate(cuts)])
        yield pd.Series(out, dtype=object)


def split_items(items: DataFrame, limits: DataFrame, id_col: str = "file_id", text_col: str = "content", key: str = "profile") -> DataFrame:
    """``(id, key, piece_no, n_pieces, begin, end, overlap_chars, piece)`` of every item.

    limits: ``(key, target_segment_chars, max_segment_chars, segment_overlap_lines)``, one row per key.
    """
    of_key = limits.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("target_segment_chars").alias("_target"), F.min("max_segment_chars").alias("_max"), F.min("segment_overlap_lines").alias("_lines"))
    rows = items.select(F.col(id_col), F.col(key), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"))
    rows = rows.filter(F.col("_text").isNotNull()).dropDuplicates([id_col, key, "_h"]).join(small_side(of_key), key, "left")
    over = (F.col("_max") > 0) & (F.length("_text") > F.col("_max"))
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("begin"), F.length("_text").alias("end"), F.lit(0).alias("overlap_chars"), F.col("_text").alias("piece")))
    cut = _pieces(F.when(over, F.col("_text")), F.coalesce("_target", "_max", F.lit(1)), F.coalesce("_max", F.lit(1)), F.coalesce("_lines", F.lit(0)))
    rows = rows.withColumn("_p", cut).withColumn("_p", F.coalesce("_p", whole))
    return rows.select(id_col, key, F.size("_p").alias("n_pieces"), F.inline("_p")).select(id_col, key, "piece_no", "n_pieces", "begin", "end", "overlap_chars", "piece")
