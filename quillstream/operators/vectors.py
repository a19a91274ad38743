"""Vectors and 64-bit hashes: similarity, prefiltered top-k, and pairs near by Hamming distance."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.sizes import small_side


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two vectors of equal length; null if either is constant."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    less = lambda v, m: F.transform(v, lambda x: x.cast("double") - m)
    x, y = less(a, total(a) / F.size(a)), less(b, total(b) / F.size(b))
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def topk(rows: DataFrame, vector: str, query: list[float], k: int = 8, where: list[Column] | None = None, tie: str = "vec_id") -> DataFrame:
    """The ``k`` rows of least cosine distance among those that pass every predicate, as ``distance``.

    Predicates come first, so they reach the scan; what is ranked is never sorted as a whole.
    """
    kept = reduce(lambda df, p: df.filter(p), where or [], rows)
    q = F.array(*[F.lit(float(x)) for x in query])
    return kept.withColumn("distance", 1.0 - cosine(F.col(vector), q)).filter("distance is not null").orderBy("distance", tie).limit(k)


def beside(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row beside every query ``(query_id, query)``: the stated queries against all rows, in the partitions of the
    rows if the queries are few, else in blocks of both."""
    return rows.crossJoin(small_side(queries))


def topk_each(rows: DataFrame, vector: str, queries: DataFrame, k: int = 8, where: list[Column] | None = None, tie: str = "vec_id", within: str | None = None) -> DataFrame:
    """Of each query ``(query_id, query)``, the ``k`` rows of least cosine distance among those that pass every
    predicate, as ``distance`` and ``rank``; within: of each value of that column. The limit on the rank cuts each block's
    rows before the shuffle."""
    kept = reduce(lambda df, p: df.filter(p), where or [], rows)
    scored = beside(kept, queries).withColumn("distance", 1.0 - cosine(F.col(vector), F.col("query"))).filter("distance is not null")
    rank = F.row_number().over(Window.partitionBy("query_id", *([within] if within else [])).orderBy("distance", tie))
    return scored.drop("query").withColumn("rank", rank).filter(F.col("rank") <= k)


def dhash(vector: Column, dims: int) -> Column:
    """Bit i is set where element i + 1 exceeds element i; dims - 1 bits. A hash is one long: more than 65 dimensions are
    an error, to be shrunk before."""
    if dims > 65:
        raise ValueError("more than 64 bits")
    bits = [F.shiftleft((F.get(vector, F.lit(i + 1)) > F.get(vector, F.lit(i))).cast("long"), i) for i in range(dims - 1)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(bits: int, most: int) -> list[int]:
    """All patterns of at most ``most`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def hash_probes(h: Column, radius: int, bits: int = 64, bands: int = 4) -> Column:
    """Keys of each band of contiguous bits, with up to ``radius`` of its bits changed; the band is in the key."""
    cuts = [bits * i // bands for i in range(bands + 1)]

    def keys(i: int, a: int, b: int) -> Column:
        part = F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(i << 48))
        return F.transform(F.array(*[F.lit(m) for m in _masks(b - a, radius)]).cast("array<bigint>"), lambda m: part.bitwiseXOR(m))

    return F.concat(*[keys(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _near_hashes(left: DataFrame, right: DataFrame, most: int, bands: int = 4) -> DataFrame:
    """``(lh, rh)``: the pairs of distinct hashes ``left(lh)`` and ``right(rh)`` at most ``most`` apart; exact.

    Of ``bands`` bands, one differs by ``most // bands`` bits at most (pigeonhole). Both sides together reach that far, so
    they meet at some key between them, and a key has sixteen bits to tell hashes apart, however great ``most`` is. How the
    reach is parted follows from the rows of either side and of the join: one side has all of it when hashes are many.
    """
    r, nl, nr = most // bands, left.count(), right.count()
    reach = lambda k: len(_masks(64 // bands, k))
    rows = lambda k: bands * (nl * reach(k) + nr * reach(r - k) + nl * nr * reach(k) * reach(r - k) / 2 ** (64 // bands))
    k = min(range(r + 1), key=rows)
    a = left.select("lh", F.explode(hash_probes(F.col("lh"), k, bands=bands)).alias("k"))
    b = right.select("rh", F.explode(hash_probes(F.col("rh"), r - k, bands=bands)).alias("k"))
    return a.join(b, "k").filter(hamming(F.col("lh"), F.col("rh")) <= most).select("lh", "rh").distinct()


def hamming_pairs(rows: DataFrame, ident: str, h: str, most: int, where: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """``(a, b, distance)``, a < b, of rows whose hashes are at most ``most`` apart, with ``a_x, b_x`` of extra; exact.

    Distinct hashes meet; their rows, and ``extra``, are joined afterwards. ``where`` speaks of ``a_x`` and ``b_x``.
    """
    extra = extra or []
    hashes = rows.filter(F.col(h).isNotNull()).select(F.col(h).alias("lh")).distinct()
    near = _near_hashes(hashes, hashes.withColumnRenamed("lh", "rh"), most)
    side = lambda p, k: rows.select(F.col(ident).alias(p), F.col(h).alias(k), *[F.col(c).alias(f"{p}_{c}") for c in extra])
    met = near.join(side("a", "lh"), "lh").join(side("b", "rh"), "rh").filter("a < b")
    met = met.filter(where) if where is not None else met
    return met.select("a", "b", hamming(F.col("lh"), F.col("rh")).alias("distance"), *[f"{p}_{c}" for c in extra for p in ("a", "b")])


def near_references(rows: DataFrame, refs: DataFrame, ident: str, h: str, most: int) -> DataFrame:
    """Rows with a reference hash at most ``most`` apart (``ident`` only, once)."""
    hashes = rows.filter(F.col(h).isNotNull()).select(F.col(h).alias("lh")).distinct()
    near = _near_hashes(hashes, refs.filter(F.col(h).isNotNull()).select(F.col(h).alias("rh")).distinct(), most)
    return rows.join(near.select(F.col("lh").alias(h)).distinct(), h, "left_semi").select(ident).distinct()


def duplicate_decision(min_dist: Column, avg_dist: Column, hist: Column, entropy: Column, threshold: int | Column = 12, hist_threshold: float = 0.90) -> Column:
    """``struct(is_duplicate, adjusted_threshold, reason)`` of two images by hashes, histogram and entropy.

    Plain images have a stricter hash limit, busy ones a looser one. A match of one hash counts only if all agree on
    average or the histogram is near; null measures never match.
    """
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    adj = F.when(entropy < 4.0, F.greatest(t - 3, F.lit(5))).when(entropy > 7.0, t + 3).otherwise(t)
    yes = lambda c: F.coalesce(c, F.lit(False))
    by_min = yes((min_dist <= adj) & ~yes((avg_dist > adj) & (F.coalesce(hist, F.lit(0.0)) < 0.85)))
    by_hist = yes(hist >= hist_threshold)
    by_avg = yes((avg_dist <= adj + 3) & (hist >= hist_threshold - 0.05))
    labels = F.filter(F.array(F.when(by_min, "Hash"), F.when(by_hist, "Hist"), F.when(by_avg, "AvgHash")), lambda x: x.isNotNull())
    dup = by_min | by_hist | by_avg
    return F.struct(dup.alias("is_duplicate"), adj.cast("int").alias("adjusted_threshold"), F.when(dup, F.array_join(labels, "+")).otherwise(F.lit("None")).alias("reason"))
