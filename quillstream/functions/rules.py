"""Decision rules over measures, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one(cond: Column, points: int = 1) -> Column:
    return F.when(cond, points).otherwise(0)


def blank_frame(m: Mapping[str, Column]) -> Column:
    """``struct(blank_score, is_blank, content_score)`` of a frame.

    m: variance and std (of the middle), mean (of the middle), entropy, dominant (per cent), diversity. Seven signs
    add up; a frame of very low entropy is blank in any case, one of rich content is not by its signs.
    """
    feed = (m["dominant"] < 10) & (m["diversity"] > 0.9)
    score = (
        _one(m["variance"] < 500) + _one(m["std"] < 15) + _one(m["entropy"] < 3.0, 2) + _one(m["dominant"] > 85)
        + _one((m["mean"] > 235) | (m["mean"] < 30)) + _one(m["diversity"] < 0.30) + _one(feed, 3)
    )
    rich = (((m["variance"] > 2000) & (m["std"] > 35)) | (m["variance"] > 5000)) & ~feed
    blank = (m["entropy"] < 3.0) | ((score >= 2) & ~rich)
    quarter = F.lit(25.0)
    content = F.least(quarter, m["variance"] / 100) + F.least(quarter, m["std"] * 5) + F.least(quarter, m["entropy"] * 3) + m["diversity"] * 25
    return F.struct(score.alias("blank_score"), blank.alias("is_blank"), F.when(blank, F.greatest(F.lit(0.0), content - 50)).otherwise(content).alias("content_score"))


def confirmed_blank(is_blank: Column, content_score: Column, text_blocks: Column, lines: Column, limit: float = 25.0) -> Column:
    """``struct(is_blank, content_score)`` after a look for text and graphics.

    A candidate is saved, and its score raised to 50, by three blocks of text or more than one line; where text was
    not looked for (null), a score over 5 saves it.
    """
    candidate = is_blank | (content_score < limit)
    unread = text_blocks.isNull() & (content_score > 5.0)
    saved = F.coalesce(text_blocks >= 3, F.lit(False)) | F.coalesce(lines > 1, F.lit(False))
    blank = candidate & ~unread & ~saved
    return F.struct(blank.alias("is_blank"), F.when(candidate & ~unread & saved, F.greatest(content_score, F.lit(50.0))).otherwise(content_score).alias("content_score"))


def meeting_view(faces: Column, face_share: Column, mean_face: Column, dark_border: Column, variance: Column, entropy: Column) -> Column:
    """``struct(confidence, relevant, kind)``: whether a frame is a video conference rather than a slide.

    mean_face: mean share of the middle that one face takes.
    """
    poor = dark_border & (variance < 4000) & (entropy < 4.5)
    points = (
        _one(dark_border & (faces >= 2), 4) + _one((variance < 3000) & (entropy < 4.0) & (faces >= 2), 3) + _one((faces >= 3) & (mean_face < 0.08) & (variance < 5000), 2)
        + F.when(poor & (variance > 2000), 1).when(poor, 3).otherwise(0) + _one((face_share > 0.4) & (faces >= 2), 2)
    )
    out = ((points >= 5) & (variance < 5000)) | (points >= 6)
    kind = F.when(out, "video_conference").when(dark_border & (variance > 2000), "slide_with_ui").otherwise("slide")
    return F.struct(points.alias("confidence"), (~out).alias("relevant"), kind.alias("kind"))


def page_dominance(chars: Column, image_share: Column, images: Column) -> Column:
    """What a page mainly is; the first rule that holds decides."""
    return (
        F.when((chars < 80) & (image_share < 0.05), "near_empty").when(image_share >= 0.85, "image_dominant")
        .when((images == 0) | (image_share < 0.05), "text_dominant").when((chars < 200) & (image_share > 0.30), "image_dominant")
        .when((chars > 1500) & (image_share < 0.15), "text_dominant").otherwise("co_dependent")
    )


def content_image(src: Column, width: Column, height: Column, size: Column) -> Column:
    """Whether an image of a page is content: a source that isn't inline and has no hint of decoration in its name,
    sides of 100 pixels or unreadable ones, 8,000 bytes."""
    from quillstream.functions.text import SKIPPED_IMAGES

    side = lambda c: F.coalesce(c.try_cast("int"), F.lit(999)) >= 100
    named = F.coalesce(src != "", F.lit(False)) & ~src.startswith("data:") & ~F.lower(src).rlike("|".join(SKIPPED_IMAGES))
    return F.coalesce(named, F.lit(False)) & side(width) & side(height) & (F.coalesce(size, F.lit(0)) >= 8000)


def distance_limit(similarity: Column) -> Column:
    """The Hamming limit that stands for a similarity, at least 2."""
    return F.greatest(F.lit(2), ((1 - similarity) * 60).cast("int"))


def legacy_seconds(filename: Column) -> Column:
    """Slide time of old names, where ``M.SS`` under 100 meant minutes and seconds; 0 without a time."""
    raw = F.regexp_extract(filename, r"_([0-9.]+)\.png", 1)
    value = raw.try_cast("double")
    dotted = raw.contains(".") & (value < 100)
    split = F.split_part(raw, F.lit("."), F.lit(1)).try_cast("int") * 60 + F.regexp_extract(raw, r"([0-9]+)$", 1).try_cast("int")
    return F.coalesce(F.when(dotted, split.cast("double")).otherwise(value), F.lit(0.0))


def consensus(models: list[Column]) -> Column:
    """The value on which the models agree, else null; a model without a value agrees with none."""
    same = models[0].isNotNull()
    for m in models[1:]:
        same = same & F.coalesce(models[0] == m, F.lit(False))
    return F.when(same, models[0])


def crop_box(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """``struct(x1, y1, x2, y2)`` in pixels of a box given as shares, within the frame and at least one pixel."""
    start = lambda n, share: F.least(F.greatest((n * share).cast("int"), F.lit(0)), n - 1)
    end = lambda n, share, a: F.least(F.greatest((n * share).cast("int"), a + 1), n)
    x1, y1 = start(width, left), start(height, top)
    return F.struct(x1.alias("x1"), y1.alias("y1"), end(width, right, x1).alias("x2"), end(height, bottom, y1).alias("y2"))


def nearest_measure(distances: Column) -> Column:
    """``struct(value, key)`` of the least entry of a map, the first key in order on ties; null for an empty map."""
    return F.array_min(F.transform(F.map_entries(distances), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))
