"""Measures of decoded frames: metrics, perceptual hashes, histograms, structure, and crops.

A frame is its raw bytes, row by row with ``channels`` bytes for each pixel, and its width. Decoding belongs to the
source; here NumPy works on whole Arrow batches of frames. A null or empty frame gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of a grey image, and of one in whole grey levels.
GREY = np.array([0.299, 0.587, 0.114])
LEVELS = np.array([19595, 38470, 7471])
METRICS = ["variance", "variance_center", "std_dev", "std_dev_center", "mean_brightness", "mean_brightness_center", "entropy", "color_diversity", "dominant_intensity_percentage"]


def frame(data: bytes, width: int, channels: int = 3) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, width, channels)


def grey(img: np.ndarray) -> np.ndarray:
    return img[..., 0].astype(float) if img.shape[2] == 1 else img[..., :3] @ GREY


def levels(img: np.ndarray) -> np.ndarray:
    """Whole grey levels, 0 to 255."""
    return img[..., 0].astype(int) if img.shape[2] == 1 else (img[..., :3] @ LEVELS + 0x8000) >> 16


def shrink(g: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a grid of rows x cols cells; a cell has at least one pixel, so a smaller frame is stretched."""
    starts = lambda n, k: np.arange(k) * n // k
    ys, xs = starts(g.shape[0], rows), starts(g.shape[1], cols)
    size = lambda at, n: np.maximum(1, np.diff(np.append(at, n)))
    # reduceat sums up to the next start, and takes the one element where that is no later.
    return np.add.reduceat(np.add.reduceat(g, ys, 0), xs, 1) / np.outer(size(ys, g.shape[0]), size(xs, g.shape[1]))


def center(g: np.ndarray, share: float = 0.1) -> np.ndarray:
    dy, dx = int(g.shape[0] * share), int(g.shape[1] * share)
    return g[dy : g.shape[0] - dy, dx : g.shape[1] - dx]


def middle(g: np.ndarray, share: float = 0.1) -> np.ndarray:
    """As :func:`center`, but with the far bounds rounded down as well."""
    ends = lambda n: slice(int(n * share), int(n * (1 - share)))
    return g[ends(g.shape[0]), ends(g.shape[1])]


def metrics(img: np.ndarray) -> dict[str, float]:
    """Of a frame and of its middle: variance over all channels, deviation and mean of grey levels. Of the frame: entropy
    of grey levels; share of 32 bins of each channel's range in use; percentage of the commonest grey level."""
    g = levels(img)
    m = middle(g)
    counts = np.bincount(g.ravel(), minlength=256) / g.size
    p = counts[counts > 0]
    used = sum(np.count_nonzero(np.histogram(img[..., k], bins=32)[0]) for k in range(img.shape[2]))
    values = (img.var(), middle(img).var(), g.std(), m.std(), g.mean(), m.mean(), -(p * np.log2(p)).sum(), used / (32.0 * img.shape[2]), counts.max() * 100)
    return dict(zip(METRICS, map(float, values)))


def _bits(flags: np.ndarray) -> int:
    n = sum(1 << i for i, f in enumerate(flags.ravel()) if f)
    return n - (1 << 64) if n >= 1 << 63 else n


def dhash(img: np.ndarray) -> int:
    s = shrink(grey(img), 8, 9)
    return _bits(s[:, 1:] > s[:, :-1])


def ahash(img: np.ndarray) -> int:
    s = shrink(grey(img), 8, 8)
    return _bits(s > s.mean())


def phash(img: np.ndarray) -> int:
    s = shrink(grey(img), 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * np.outer(k[:8], 2 * k + 1) / 64)
    low = basis @ s @ basis.T
    return _bits(low > np.median(low.ravel()[1:]))


def whash(img: np.ndarray) -> int:
    """Of the low band of Haar wavelets, which is the means of cells, those over the median."""
    s = shrink(grey(img), 8, 8)
    return _bits(s > np.median(s))


def histogram(img: np.ndarray) -> np.ndarray:
    """256 bins of each channel, each channel adding up to 1."""
    return np.concatenate([np.bincount(img[..., k].ravel(), minlength=256) / img[..., k].size for k in range(img.shape[2])])


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a - a.mean(), b - b.mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n else float(np.array_equal(a, b))


def _window_means(z: np.ndarray, window: int) -> np.ndarray:
    """Means of all windows that lie within."""
    c = np.pad(z, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (c[window:, window:] - c[:-window, window:] - c[window:, :-window] + c[:-window, :-window]) / window**2


def ssim(a: np.ndarray, b: np.ndarray, rows: int = 200, cols: int = 300, window: int = 7) -> float:
    """Structural similarity of two grey frames of 300 x 200, each first without a tenth on every side if it has over 20
    pixels on both; variances are those of samples."""
    cut = lambda i: center(i) if min(i.shape[:2]) > 20 else i
    x, y = (shrink(grey(cut(i)), rows, cols) for i in (a, b))
    mean = lambda z: _window_means(z, window)
    mx, my, n = mean(x), mean(y), window**2
    vx, vy, cov = ((mean(p * q) - mp * mq) * n / (n - 1) for p, q, mp, mq in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def grid_similarity(a: np.ndarray, b: np.ndarray, n: int = 8, near: float = 0.95) -> float:
    """Share of n x n cells that are alike by more than ``near``."""
    x, y = grey(a), grey(b)
    if x.shape != y.shape:
        rows, cols = min(x.shape[0], y.shape[0]), min(x.shape[1], y.shape[1])
        x, y = shrink(x, rows, cols), shrink(y, rows, cols)
    cell = lambda z, i, j: z[z.shape[0] * i // n : z.shape[0] * (i + 1) // n, z.shape[1] * j // n : z.shape[1] * (j + 1) // n]
    return float(np.mean([1 - np.abs(cell(x, i, j) - cell(y, i, j)).mean() / 255 > near for i in range(n) for j in range(n)]))


def content_box(img: np.ndarray, share: float = 0.1, margin: float = 0.01) -> tuple[int, int, int, int]:
    """``(x1, y1, x2, y2)`` from the first to the last row and column whose sums of edges exceed a share of the greatest,
    then a margin further in; the whole frame where nothing is left."""
    p = np.pad(grey(img), 1, mode="reflect" if min(img.shape[:2]) > 1 else "edge")
    smooth = lambda z: z[:-2] + 2 * z[1:-1] + z[2:]
    gx = smooth(p[:, 2:] - p[:, :-2])
    gy = smooth((p[2:] - p[:-2]).T).T
    edges = np.hypot(gx, gy)
    whole = (0, 0, img.shape[1], img.shape[0])
    if not edges.any():
        return whole
    box = []
    for sums, n in ((edges.sum(0), img.shape[1]), (edges.sum(1), img.shape[0])):
        at = np.flatnonzero(sums > share * sums.max())
        box.append((int(at[0]) + int(n * margin), int(at[-1]) - int(n * margin)))
    (x1, x2), (y1, y2) = box
    return (x1, y1, x2, y2) if x1 < x2 and y1 < y2 else whole


def dark_border(img: np.ndarray, dark: float = 30.0, share: float = 0.05) -> float:
    """Share of dark pixels in a border of a share of the frame's lesser side."""
    g = grey(img)
    w = max(1, int(min(g.shape) * share))
    edge = np.ones(g.shape, bool)
    edge[w:-w, w:-w] = False
    return float((g[edge] < dark).mean())


def bar_heights(img: np.ndarray, share: float = 0.15, most: int = 100, dark: float = 50.0, flat: float = 100.0) -> tuple[int, int]:
    """Heights of the bars above and below: rows that are dark on average or of little variance, as many as follow each
    other from the border, up to a share of the frame and ``most`` rows; one row fewer below."""
    rows = img.reshape(img.shape[0], -1).astype(float)
    bar = (rows.mean(1) < dark) | (rows.var(1) < flat)
    limit = min(int(len(bar) * share), most)
    run = lambda b: int(np.argmin(np.append(b, False)))
    return run(bar[:limit]), run(bar[::-1][: max(0, limit - 1)])


def crop(width: int, height: int, left: float, top: float, right: float, bottom: float) -> tuple[int, int, int, int]:
    """Pixels of a box given as shares, within the frame and at least one pixel."""
    x1, y1 = min(max(int(width * left), 0), width - 1), min(max(int(height * top), 0), height - 1)
    return x1, y1, min(max(int(width * right), x1 + 1), width), min(max(int(height * bottom), y1 + 1), height)


# A method by name; an unknown name gives structural similarity.
SIMILARITY: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "ssim": ssim,
    "phash": lambda a, b: 1 - ((phash(a) ^ phash(b)) & (2**64 - 1)).bit_count() / 64,
    "grid": grid_similarity,
    "histogram": lambda a, b: correlation(histogram(a), histogram(b)),
}

_HASHERS = {"phash": phash, "dhash": dhash, "ahash": ahash, "whash": whash}
_METRICS = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])
_HASHES = T.StructType([T.StructField(h, T.LongType()) for h in _HASHERS])
_CROPS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2", "bar_top", "bar_bottom")] + [T.StructField("dark_border", T.DoubleType())])


@F.pandas_udf(_METRICS)
def frame_metrics(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, width in batches:
        yield pd.DataFrame([metrics(frame(d, int(w))) if d else dict.fromkeys(METRICS) for d, w in zip(data, width)], columns=METRICS, dtype="float64")


@F.pandas_udf(_HASHES)
def frame_hashes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, width in batches:
        rows = [{n: f(frame(d, int(w))) for n, f in _HASHERS.items()} if d else dict.fromkeys(_HASHERS) for d, w in zip(data, width)]
        yield pd.DataFrame(rows, columns=list(_HASHERS), dtype="Int64")


@F.pandas_udf(_CROPS)
def frame_crops(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The box of a frame's content, the heights of its bars, and how dark its border is."""
    names = [f.name for f in _CROPS.fields]
    for data, width in batches:
        frames = [frame(d, int(w)) if d else None for d, w in zip(data, width)]
        rows = [(None,) * len(names) if f is None else (*content_box(f), *bar_heights(f), dark_border(f)) for f in frames]
        yield pd.DataFrame(rows, columns=names).astype({n: "float64" if n == "dark_border" else "Int32" for n in names})


def similarity(method: str):
    """A UDF ``(frame, width, frame, width) -> double`` by the method's name."""
    f = SIMILARITY.get(method, ssim)

    @F.pandas_udf(T.DoubleType())
    def alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, wa, b, wb in batches:
            yield pd.Series([f(frame(x, int(m)), frame(y, int(n))) if x and y else None for x, m, y, n in zip(a, wa, b, wb)], dtype="float64")

    return alike
