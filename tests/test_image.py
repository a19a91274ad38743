"""Measures of frames, by small frames whose measures are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import image as im


def flat(v, h=40, w=60):
    return np.full((h, w, 3), v, np.uint8)


def noise(seed, h=40, w=60):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_same_frame_is_alike_and_white_is_not():
    a = noise(1)
    for f in im.SIMILARITY.values():
        assert f(a, a) == pytest.approx(1.0)
    assert im.ssim(a, flat(255)) < 0.9
    assert im.correlation(im.histogram(flat(10)), im.histogram(flat(200))) < 1.0


def test_hashes_tell_frames_apart():
    a, b = noise(1), noise(2)
    for f in (im.phash, im.dhash, im.ahash, im.whash):
        assert f(a) == f(a.copy()) and f(a) != f(b) and -(2**63) <= f(a) < 2**63


def test_metrics_of_channels_and_middle():
    m = im.metrics(flat(100))
    assert m["variance"] == m["variance_center"] == m["entropy"] == 0 and m["mean_brightness"] == 100 and m["dominant_intensity_percentage"] == 100
    assert m["color_diversity"] == pytest.approx(1 / 32)
    red = flat(0)
    red[..., 0] = 255
    # Of the channels 255, 0, 0 the variance is that of all their values; the grey level is the same everywhere.
    assert im.metrics(red)["variance"] == pytest.approx(np.var([255, 0, 0])) and im.metrics(red)["std_dev"] == 0
    framed = flat(0, 100, 100)
    framed[10:90, 10:90] = 200
    assert im.metrics(framed)["variance"] > 0 == im.metrics(framed)["variance_center"]


def test_shrink_equals_means_of_cells():
    g = np.random.default_rng(3).random((20, 13))
    for rows, cols in ((4, 5), (20, 13), (32, 32), (1, 1)):
        got = im.shrink(g, rows, cols)
        for r in range(rows):
            for c in range(cols):
                ys = slice(20 * r // rows, max(20 * (r + 1) // rows, 20 * r // rows + 1))
                xs = slice(13 * c // cols, max(13 * (c + 1) // cols, 13 * c // cols + 1))
                assert got[r, c] == pytest.approx(g[ys, xs].mean())


def test_bars_and_boxes():
    img = noise(4, 200, 200)
    img[:12], img[-9:] = 0, 128
    assert im.bar_heights(img) == (12, 9)
    assert im.bar_heights(flat(90, 200, 200)) == (30, 29)
    page = flat(255, 200, 300)
    page[50:150, 60:240] = noise(5, 100, 180)
    x1, y1, x2, y2 = im.content_box(page)
    assert (abs(x1 - 62) <= 2, abs(y1 - 51) <= 2, abs(x2 - 237) <= 2, abs(y2 - 148) <= 2) == (True,) * 4
    assert im.content_box(flat(7)) == (0, 0, 60, 40)
    assert im.crop(1280, 720, -0.1, 0.5, 2, 0.4) == (0, 360, 1280, 361)


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([(1, bytearray(noise(6, 8, 8).tobytes())), (2, None), (3, bytearray())], "i int, px binary")
    rows = df.select("i", im.frame_hashes("px", F.lit(8)).alias("h"), im.frame_metrics("px", F.lit(8)).alias("m"), im.frame_crops("px", F.lit(8)).alias("c")).collect()
    got = {r["i"]: r for r in rows}
    assert got[1]["h"]["dhash"] == im.dhash(noise(6, 8, 8)) and got[1]["c"]["x2"] > 0
    assert all(v is None for i in (2, 3) for part in ("h", "m", "c") for v in got[i][part])
