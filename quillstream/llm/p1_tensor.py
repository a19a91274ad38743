"""Problem 1: near-duplicate records with small edits.

Method: tensored banding. Two collections of ``m`` half keys, each the combination of ``k`` minhashes, are paired
into ``m * m`` table keys, so 2*m*k minhashes serve as many tables as ``m * m * 2k`` would. Two records meet if any
half key of each collection agrees; at similarity s that has the chance ``(1 - (1 - s**k)**m)**2``. The table keys are
never rows: records are shuffled by half keys of the first collection, a few at a time, and what has one in common is compared by those of the
second in memory. Pairs that meet
pass a sketch of two bits of each minhash there and are verified exactly on their words. ``k`` follows the number of records,
so that a record's meetings by chance stay bounded, and ``m`` follows ``k``, so that recall stays (:meth:`Tensor.for_records`).

Records of the same distinct words form one class first: a class is one row of the join, however many records it
has. Only records of equal raw texts are copies; many of them are given as a star instead of all pairs.

Defined results: null texts count as empty; a record without words is similar to none; rows equal in id and words
count once, null ids are left out; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillstream.operators.graph import star_components
from quillstream.session import Scratch


#: Members of a class that are the left side of one part of its pairs.
PART_MEMBERS = 256


@dataclass(frozen=True)
class Tensor:
    """m: half keys in a collection; k: minhashes in a half key; slack: share of sketch fields, in standard
    deviations below what a pair at the threshold has on average, that a pair may lack."""

    m: int = 14
    k: int = 3
    slack: float = 4.0
    seed: int = 20240131

    @classmethod
    def for_records(cls, n: int, threshold: float, recall: float = 0.93, background: float = 0.15, most: float = 1000.0) -> Tensor:
        """The tensor for n records. k: the least at which a record meets ``most`` others by chance, if unlike records
        have ``background`` of their words in common; m: the least at which a pair at the threshold meets with the
        chance ``recall``. So a record's chance meetings stay bounded as records grow, at the same recall."""
        k = 2
        while True:
            k += 1
            m = ceil(log(1 - sqrt(recall)) / log(1 - threshold**k))
            if k == 12 or n * m * m * background ** (2 * k) <= most:
                return cls(m, k)


def words(*texts: str) -> Column:
    """The distinct words of columns taken together, sorted; case and punctuation aside."""
    joined = F.lower(F.concat_ws(" ", *[F.col(t) for t in texts]))
    return F.array_sort(F.array_distinct(F.filter(F.split(joined, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: Fields of two bits in a long of a sketch.
FIELDS = 31
#: Bytes a record of the rows that are shuffled by half keys at once; the half keys are taken in as many rounds as that needs.
ROUND_BYTES = 450
#: Rows of a block of whole half keys that is compared at once, and records that are signed at once.
BLOCK_ROWS, SIGN_ROWS = 1 << 16, 1 << 10
#: Pairs that a task holds before it gives them on.
HELD_PAIRS = 1 << 20


def _sizes(t: Tensor) -> tuple[int, int]:
    """Longs of a sketch, and bytes of the half keys of the second collection and the sketch together."""
    longs = -(-2 * t.m * t.k // FIELDS)
    return longs, 4 * (t.m + t.m % 2) + 8 * longs


def _signed(t: Tensor):
    """``(cid, hashes)`` to ``(cid, a0..., rest)``, a batch at a time: the half keys of the first collection, four bytes each, and beside
    them in one binary those of the second and the sketch, two bits of each minhash, :data:`FIELDS` of them in a long."""
    n = 2 * t.m * t.k
    rng = np.random.default_rng(t.seed)
    mul = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    longs, width = _sizes(t)

    def of(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(starts)
        mins = np.stack([np.minimum.reduceat(_mixed(flat * mul[i] + add[i]), starts) for i in range(n)])
        half = np.zeros((2 * t.m, rows), np.uint64)
        for i in range(2 * t.m):
            for j in range(t.k):
                half[i] = _mixed(half[i] * np.uint64(0xC2B2AE3D27D4EB4F) + mins[i * t.k + j] + np.uint64(i))
        half = (half >> np.uint64(32)).astype(np.uint32)
        bits = _mixed(mins) >> np.uint64(62)
        sketch = np.zeros((rows, longs), np.uint64)
        for i in range(n):
            sketch[:, i // FIELDS] |= bits[i] << np.uint64(2 * (i % FIELDS))
        rest = np.zeros((rows, width), np.uint8)
        rest[:, : 4 * t.m] = np.ascontiguousarray(half[t.m :].T).view(np.uint8)
        rest[:, width - 8 * longs :] = sketch.view(np.uint8)
        return half[: t.m], rest

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SIGN_ROWS):
                batch = whole.slice(at, SIGN_ROWS)
                lists, rows = batch.column("hashes"), batch.num_rows
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
                first, rest = of(flat, starts)
                ends = pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
                cols = [batch.column("cid"), *[pa.array(x.view(np.int32)) for x in first], pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(rest)])]
                yield pa.RecordBatch.from_arrays(cols, names=["cid", *[f"a{i}" for i in range(t.m)], "rest"])

    return sign


def _meeting(t: Tensor, threshold: float):
    """``(key, cid, rest)`` in the order of keys to the pairs ``(a, b)``, a < b, that have a key and a half key of the second collection
    in common and whose sketches are alike: a field of a pair at similarity s agrees with the chance (1 + 3s) / 4. Whole keys are
    compared, so a task holds a block, or the rows of one key."""
    n, p = 2 * t.m * t.k, (1 + 3 * threshold) / 4
    most = n - int(p * n - t.slack * (n * p * (1 - p)) ** 0.5)
    longs, width = _sizes(t)

    def met(keys: np.ndarray, cids: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = keys[1:] == keys[:-1]
        shared = np.append(same, False) | np.append(False, same)
        keys, cids, rest = keys[shared], cids[shared], rest[shared]
        rows, found, held = len(keys), [], 0
        if not rows:
            return

        def given() -> pa.RecordBatch:
            x, y = np.divmod(np.unique(np.concatenate(found)), rows)
            found.clear()
            x, y = cids[x], cids[y]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        group = np.append(0, np.cumsum(keys[1:] != keys[:-1])).astype(np.uint64) << np.uint64(32)
        second = np.ascontiguousarray(rest[:, : 4 * t.m].T.reshape(t.m, 4, rows).transpose(0, 2, 1)).view(np.uint32)[:, :, 0]
        sketch = np.ascontiguousarray(rest[:, width - 8 * longs :]).view(np.uint64)
        low = np.uint64(rows.bit_length())
        own, row_bits = np.arange(rows, dtype=np.uint64), (np.uint64(1) << low) - np.uint64(1)
        for j in range(t.m):
            # Hashes over row numbers: one sort brings together what agrees in both half keys.
            code = np.sort(_mixed((group | second[j]) * np.uint64(0xFF51AFD7ED558CCD)) & ~row_bits | own)
            heads, row = code >> low, (code & row_bits).astype(np.int64)
            at, d = np.flatnonzero(heads[1:] == heads[:-1]), 1
            while at.size:
                for part in range(0, at.size, BLOCK_ROWS):
                    x, y = row[at[part : part + BLOCK_ROWS]], row[at[part : part + BLOCK_ROWS] + d]
                    differ = sketch[x] ^ sketch[y]
                    differ = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
                    alike = differ <= most
                    found.append(np.minimum(x, y)[alike] * rows + np.maximum(x, y)[alike])
                    held += len(found[-1])
                    if held > HELD_PAIRS:
                        yield given()
                        held = 0
                d += 1
                at = at[: np.searchsorted(at, rows - d)]
                at = at[heads[at + d] == heads[at]]
        if held:
            yield given()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch.column("rest")
            flat = np.frombuffer(rest.buffers()[2], np.uint8)[rest.offset * width :][: batch.num_rows * width].reshape(-1, width)
            kept.append((batch.column("key").to_numpy(), batch.column("cid").to_numpy(), flat))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS and kept[-1][0][-1] != kept[0][0][0]:
                keys, cids, rests = (np.concatenate(x) for x in zip(*kept))
                end = np.searchsorted(keys, keys[-1])
                yield from met(keys[:end], cids[:end], rests[:end])
                kept, rows = [(keys[end:].copy(), cids[end:].copy(), rests[end:].copy())], len(keys) - end
        if kept:
            yield from met(*(np.concatenate(x) for x in zip(*kept)))

    return meet


def word_classes(records: DataFrame, id_col: str, texts: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """``(id, cid, tid)`` of every record with words, the classes ``(cid, words, n, rep)``, and how many there are; rep
    is the least id. Classes are numbered, and told by their words, not by a hash of them.
    Records of equal raw texts share ``tid``; one that comes with several texts of a class has the least of them."""
    raw = F.xxhash64(F.to_json(F.array(*[F.coalesce(F.col(t), F.lit("")) for t in texts])))
    rows = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words(*texts).alias("words"), raw.alias("tid"))
    rows = rows.filter(F.size("words") > 0).withColumn("h", F.xxhash64("words"))
    rows = scratch.cut(rows.groupBy("id", "h", "words").agg(F.min("tid").alias("tid")), "records", tidy=True)
    seen = Observation()
    classes = rows.groupBy("h", "words").agg(F.count("*").alias("n"), F.min("id").alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.cut(classes.observe(seen, F.count("*").alias("classes")), "classes", tidy=True)
    members = scratch.cut(rows.join(classes.select("h", "words", "cid"), ["h", "words"]).select("id", "cid", "tid"), "members", tidy=True)
    scratch.drop(rows)
    return members, classes.drop("h"), seen.get["classes"]


def _met_classes(classes: DataFrame, threshold: float, t: Tensor, scratch: Scratch) -> DataFrame:
    """``(a, b)``, a < b: pairs of classes that meet and pass the sketch.

    Rows of a class go by its half keys of the first collection, some of them a round, so that what is on disk at once
    stays at :data:`ROUND_BYTES` a class or one row, whatever ``m`` and ``k`` are.
    """
    hashed = classes.select("cid", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    signed = scratch.cut(hashed.mapInArrow(_signed(t), "cid bigint, " + ", ".join(f"a{i} int" for i in range(t.m)) + ", rest binary"), "signed")
    step = max(1, ROUND_BYTES // (32 + _sizes(t)[1]))
    rounds = []
    for lo in range(0, t.m, step):
        keys = F.array(*[F.col(f"a{i}").cast("long") + F.lit(i << 32) for i in range(lo, min(t.m, lo + step))])
        rows = signed.select(F.explode(keys).alias("key"), "cid", "rest").repartition("key").sortWithinPartitions("key")
        rounds.append(scratch.cut(rows.mapInArrow(_meeting(t, threshold), "a bigint, b bigint"), "met", tidy=True))
    met = scratch.cut(reduce(DataFrame.unionByName, rounds).distinct(), "near", tidy=True)
    for done in (signed, *rounds):
        scratch.drop(done)
    return met


def similar_classes(classes: DataFrame, threshold: float, tensor: Tensor, scratch: Scratch) -> DataFrame:
    """``(a, b, jaccard)``, a < b: pairs of classes with at least ``threshold`` of their words in common."""
    near = _met_classes(classes, threshold, tensor, scratch)
    # Most pairs that pass the sketch are told by hashes of four bytes a word. Words of equal hash may hide one common
    # word of a pair, so one more is granted; the words themselves decide.
    brief = lambda p: classes.select(F.col("cid").alias(p), F.size("words").alias(f"n{p}"), F.transform("words", lambda w: F.hash(w)).alias(f"h{p}"))
    common = F.size(F.array_intersect("ha", "hb")) + 1
    near = near.join(brief("a"), "a").join(brief("b"), "b").filter(common >= F.lit(threshold) * (F.col("na") + F.col("nb") - common) - 1e-9).select("a", "b")
    wa = classes.select(F.col("cid").alias("a"), F.col("words").alias("wa"))
    wb = classes.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    both = near.join(wa, "a").join(wb, "b").withColumn("i", F.size(F.array_intersect("wa", "wb")))
    both = both.withColumn("u", F.size("wa") + F.size("wb") - F.col("i"))
    return both.filter(F.col("i") >= F.lit(threshold) * F.col("u") - 1e-9).select("a", "b", (F.col("i") / F.col("u")).alias("jaccard"))


def similar_pairs(records: DataFrame, id_col: str, texts: list[str], threshold: float = 0.6, tensor: Tensor | None = None,
                  expand_copies: int = 32) -> DataFrame:
    """``(id_a, id_b)``, the smaller first: pairs of different records that share enough words.

    Records of equal words are pairs as well. More than ``expand_copies`` records of equal raw texts are given as
    pairs of their least id with each of the others, and meet other texts through that id; :func:`similar_groups` gives
    every record with its class and the number of records in it, and a high ``expand_copies`` all pairs. Different texts meet in
    full, whatever the size of their class; a class is split by its members, so no task has all of its pairs.
    """
    scratch = Scratch(records.sparkSession, "p1")
    members, classes, n = word_classes(records, id_col, texts, scratch)
    tensor = tensor or Tensor.for_records(n, threshold)
    pairs = scratch.cut(similar_classes(classes, threshold, tensor, scratch).select("a", "b"), "pairs", tidy=True)
    copies = members.groupBy("tid", "cid").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    sized = scratch.cut(members.join(copies, ["tid", "cid"]), "sized", tidy=True)
    shown = sized.filter((F.col("n") <= expand_copies) | (F.col("id") == F.col("rep"))).select("cid", "id")
    # The left side of a meeting is spread over the members of a class, the right side is copied to each part.
    parts = shown.groupBy("cid").agg(F.ceil(F.count("*") / PART_MEMBERS).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    salted = scratch.cut(shown.join(parts, "cid").select("cid", "id", "parts", salt.alias("part")), "shown", tidy=True)
    left = salted.select(F.col("cid").alias("a"), "part", F.col("id").alias("x"))
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    met = pairs.join(parts.select(F.col("cid").alias("a"), "parts"), "a").select("a", "b", "parts")
    right = salted.select(F.col("cid").alias("b"), F.col("id").alias("y")).join(met, "b").select("a", "y", every_part)
    across = left.join(right, ["a", "part"]).select("x", "y").filter("x <> y")
    own = salted.select(F.col("cid").alias("a"), F.col("id").alias("y"), every_part)
    inner = left.join(own, ["a", "part"]).select("x", "y").filter("x < y")
    stars = sized.filter(F.col("id") != F.col("rep")).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    every = across.unionByName(stars).unionByName(inner)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_groups(records: DataFrame, id_col: str, texts: list[str], threshold: float = 0.6, tensor: Tensor | None = None) -> DataFrame:
    """``(id, class_id, class_size, group_id, links)`` of every record: the least id of the records of equal words and
    their number, the least id of its group, and how many other classes its class is similar to. A record that comes with
    several texts has the least of its classes and groups, and the greatest of its numbers."""
    scratch = Scratch(records.sparkSession, "p1")
    members, classes, n = word_classes(records, id_col, texts, scratch)
    tensor = tensor or Tensor.for_records(n, threshold)
    pairs = scratch.cut(similar_classes(classes, threshold, tensor, scratch).select("a", "b"), "pairs", tidy=True)
    labels = star_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    links = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("links"))
    own = classes.select("cid", "rep", "n").join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
    own = own.select("cid", "rep", "n", F.coalesce("label", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    roots = own.groupBy("label").agg(F.min("rep").alias("group_id"))
    grouped = members.select("id", "cid").join(own.join(roots, "label"), "cid")
    bare = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().join(members.select("id"), "id", "left_anti")
    return grouped.groupBy("id").agg(F.min("rep").alias("class_id"), F.max("n").alias("class_size"), F.min("group_id").alias("group_id"), F.max("links").alias("links")).unionByName(
        bare.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("links")))
