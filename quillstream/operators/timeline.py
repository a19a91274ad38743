"""Joins along time: lines to the slide on screen, backward as-of, nearest, and bands.

All of them are keyed by the document first. A document may be endless and hold most rows, so none of them sorts a
document as a whole: time is cut into stretches, a stretch is sorted alone, and what it needs to know of the slides
before and after it comes from a table of one row per stretch. A line meets one slide, so no key is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a stretch.
STRETCH = 3600.0


def _stretch(t: str) -> Column:
    return F.floor(F.col(t) / F.lit(STRETCH))


def _between(rows: DataFrame, key: str, edges: list[Column], before: str, after: str) -> DataFrame:
    """``rows`` of stretches ``_b`` with the last ``_hi`` of the stretches before theirs, and the first ``_lo`` of those
    after it. edges: the aggregates ``_lo`` and ``_hi`` of a stretch."""
    w = Window.partitionBy(key).orderBy("_b")
    ends = rows.groupBy(key, "_b").agg(*edges)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(key, "_b", F.last("_hi", ignorenulls=True).over(back).alias(before), F.first("_lo", ignorenulls=True).over(ahead).alias(after))
    return rows.join(ends, [key, "_b"])


def spans(slides: DataFrame, key: str, t: str, tie: str, tail: float | None = None, head_inclusive: bool = False) -> DataFrame:
    """Slides with the span ``[span_from, span_to)`` up to the next slide of the key.

    The last span is open (null), or ``tail`` long. With head_inclusive, the first slide also owns what came before.
    Slides of null time or key own nothing and are left out.
    """
    rows = slides.filter(F.col(t).isNotNull() & F.col(key).isNotNull()).withColumn("_b", _stretch(t))
    rows = _between(rows, key, [F.min(t).alias("_lo"), F.max(t).alias("_hi")], "_before", "_after")
    w = Window.partitionBy(key, "_b").orderBy(t, tie)
    nxt = F.coalesce(F.lead(t).over(w), F.col("_after"))
    end = nxt if tail is None else F.coalesce(nxt, F.col(t) + F.lit(tail))
    first = F.col("_before").isNull() & (F.row_number().over(w) == 1)
    start = F.when(first, F.lit(float("-inf"))).otherwise(F.col(t)) if head_inclusive else F.col(t)
    return rows.withColumn("span_to", end).withColumn("span_from", start).drop("_b", "_before", "_after")


def interval_join(slides: DataFrame, lines: DataFrame, key: str, t: str, tie: str, line_cols: list[str],
                  tail: float | None = None, head_inclusive: bool = False) -> DataFrame:
    """Each slide with the lines in its span, left outer: ``slides.*`` and ``line_cols`` (null without a line).

    Each line finds its slide as an as-of join does, and meets it by equality; ``tie`` tells slides apart.
    """
    s = spans(slides, key, t, tie, tail, head_inclusive)
    l = lines.select(F.col(key), F.col(t).cast("double").alias("_t"), F.struct(*line_cols).alias("_line"))
    own = s.select(F.col(key), F.col(t).cast("double").alias("_t"), F.struct(F.col(t).cast("double").alias("t"), F.col(tie).alias("tie"), "span_from", "span_to").alias("_slide"))
    u = _found(l, own, key, head_inclusive)
    at = F.col("_own.span_from") <= F.col("_t")
    u = u.filter(at & (F.col("_own.span_to").isNull() | (F.col("_t") < F.col("_own.span_to"))))
    met = u.select(F.col(key).alias("_k"), F.col("_own.t").alias("_st"), F.col("_own.tie").alias("_tie"), "_line").alias("l")
    s = s.alias("s")
    on = (F.col(f"s.{key}") == F.col("l._k")) & (F.col(f"s.{t}").cast("double") == F.col("l._st")) & (F.col(f"s.{tie}") == F.col("l._tie"))
    return s.join(met, on, "left").select("s.*", *[F.col(f"l._line.{c}").alias(c) for c in line_cols])


def _found(lines: DataFrame, slides: DataFrame, key: str, or_next: bool = False) -> DataFrame:
    """``lines(key, _t, _line)`` with the last ``_slide`` of ``slides(key, _t, _slide)`` at or before them as ``_own``;
    ``_slide`` is a struct whose order is that of the slides. or_next: a line before all slides gets the first one."""
    kind = slides.schema["_slide"].dataType
    u = lines.select(key, "_t", "_line", F.lit(None).cast(kind).alias("_slide"), F.lit(1).alias("_kind"))
    u = u.unionByName(slides.select(key, "_t", F.lit(None).cast(lines.schema["_line"].dataType).alias("_line"), "_slide", F.lit(0).alias("_kind")))
    u = u.filter(F.col(key).isNotNull() & F.col("_t").isNotNull()).withColumn("_b", _stretch("_t"))
    u = _between(u, key, [F.min("_slide").alias("_lo"), F.max("_slide").alias("_hi")], "_before", "_after")
    w = Window.partitionBy(key, "_b").orderBy("_t", "_kind", "_slide")
    own = F.coalesce(F.last("_slide", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    if or_next:
        own = F.coalesce(own, F.first("_slide", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("_after"))
    return u.withColumn("_own", own).filter("_kind = 1").select(key, "_t", "_line", "_own")


def _sides(lines: DataFrame, slides: DataFrame, key: str, t: str, line_id: str, slide_id: str, shift: float) -> tuple[DataFrame, DataFrame]:
    a = lines.select(F.col(key), (F.col(t) + F.lit(shift)).cast("double").alias("_t"), F.col(line_id).alias("_line"))
    b = slides.filter(F.col(t).isNotNull()).select(F.col(key), F.col(t).cast("double").alias("_t"), F.struct(F.col(t).cast("double").alias("t"), F.col(slide_id).alias("id")).alias("_slide"))
    return a, b


def asof_backward(lines: DataFrame, slides: DataFrame, key: str, t: str, line_id: str, slide_id: str, tolerance: float = 0.0) -> DataFrame:
    """``(key, line_id, slide_id, slide_t)``: the last slide with ``slide.t <= line.t + tolerance``, or null.

    Of slides of equal time the greater id wins. Lines without key or time are left out.
    """
    found = _found(*_sides(lines, slides, key, t, line_id, slide_id, tolerance), key)
    return found.select(key, F.col("_line").alias(line_id), F.col("_own.id").alias(slide_id), F.col("_own.t").alias("slide_t"))


def asof_with_fallback(lines: DataFrame, slides: DataFrame, key: str, t: str, line_id: str, slide_id: str, tolerance: float, within: float) -> DataFrame:
    """As :func:`asof_backward`; a line before all slides gets the key's first slide if that is ``within`` reach."""
    found = asof_backward(lines, slides, key, t, line_id, slide_id, tolerance)
    first = slides.filter(F.col(t).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(t).cast("double").alias("ft"), F.col(slide_id).alias("fs"))).alias("f"))
    timed = found.join(lines.select(F.col(line_id), F.col(t).alias("_lt")), line_id).join(first, key, "left")
    near = F.when(F.abs(F.col("f.ft") - F.col("_lt")) <= within, F.col("f.fs"))
    return timed.select(key, line_id, F.coalesce(F.col(slide_id), near).alias(slide_id))


def nearest(lines: DataFrame, slides: DataFrame, key: str, t: str, line_id: str, slide_id: str) -> DataFrame:
    """``(key, line_id, slide_id)``: the slide nearest in time before or after; of equally near ones the earlier, of
    those of equal time the lesser id. Lines without key or time are left out."""
    a, b = _sides(lines, slides, key, t, line_id, slide_id, 0.0)
    b = b.groupBy(key, "_t").agg(F.min("_slide").alias("_slide"))
    u = a.withColumn("_kind", F.lit(1)).withColumn("_slide", F.lit(None).cast(b.schema["_slide"].dataType))
    u = u.unionByName(b.withColumn("_kind", F.lit(0)).withColumn("_line", F.lit(None).cast(a.schema["_line"].dataType)))
    u = u.filter(F.col(key).isNotNull() & F.col("_t").isNotNull()).withColumn("_b", _stretch("_t"))
    u = _between(u, key, [F.min("_slide").alias("_lo"), F.max("_slide").alias("_hi")], "_before", "_after")
    w = Window.partitionBy(key, "_b").orderBy("_t", "_kind")
    p = F.coalesce(F.last("_slide", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    n = F.coalesce(F.first("_slide", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("_after"))
    u = u.withColumn("p", p).withColumn("n", n).filter("_kind = 1")
    dp, dn = F.col("_t") - F.col("p.t"), F.col("n.t") - F.col("_t")
    pick: Column = F.when(F.col("p").isNull(), F.col("n.id")).when(F.col("n").isNull() | (dp <= dn), F.col("p.id")).otherwise(F.col("n.id"))
    return u.select(key, F.col("_line").alias(line_id), pick.alias(slide_id))


def band_pairs(rows: DataFrame, key: str, t: str, ident: str, width: float, extra: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Pairs ``a`` before ``b`` of a key at most ``width`` apart: ``(key, a_id, b_id, dt)`` and ``a_x, b_x`` of extra.

    Time is cut into stretches of the width; a row meets its own and the next stretch by equality.
    """
    extra = extra or []
    side = lambda p: rows.select(F.col(key), *[F.col(c).alias(f"{p}_{c}") for c in (t, ident, *extra)], F.floor(F.col(t) / F.lit(width)).alias("_w"))
    a = side("a").withColumn("_w", F.explode(F.array(F.col("_w"), F.col("_w") + 1)))
    b = side("b")
    dt = F.col(f"b_{t}") - F.col(f"a_{t}")
    after = (dt > 0) | ((dt == 0) & (F.col(f"a_{ident}") < F.col(f"b_{ident}")))
    out = a.join(b, [key, "_w"]).filter(after & (dt <= width)).withColumn("dt", dt)
    out = out.filter(where) if where else out
    return out.select(key, F.col(f"a_{ident}").alias("a_id"), F.col(f"b_{ident}").alias("b_id"), "dt", *[f"{p}_{c}" for c in extra for p in ("a", "b")])


def gaps(rows: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """Rows with ``gap``, the time since the row before of the same key; null for the first."""
    return rows.withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t, tie)))


def forward_fill(rows: DataFrame, key: str, order: list[str], value: str, out: str, default: str | None = None) -> DataFrame:
    """The last value that wasn't null, carried forward along the order; ``default`` before the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(value, ignorenulls=True).over(w)
    return rows.withColumn(out, F.coalesce(filled, F.lit(default)) if default is not None else filled)


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before; the first row of a key always does."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter(
        (F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")
