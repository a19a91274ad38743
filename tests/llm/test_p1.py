import os
import random
import threading
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import p1_tensor as p1
from quillstream.session import shared_dir

SCHEMA = "unit_id string, summary string, verbatim_anchor string, i int, words string"


def brute(rows, threshold=0.6):
    import re

    sets = {}
    for u, a, b, *_ in rows:
        if u is not None:
            w = frozenset(re.findall(r"[^\W_]+", f"{a or ''} {b or ''}".lower()))
            if w:
                sets.setdefault(u, set()).add(w)
    out = set()
    for x, y in combinations(sorted(sets), 2):
        if any(len(a & b) >= threshold * len(a | b) - 1e-9 for a in sets[x] for b in sets[y]):
            out.add((x, y))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for g in range(60):
        base = rng.sample(vocab, 30)
        for k in range(rng.randint(1, 4)):
            w = [x if rng.random() > 0.08 else rng.choice(vocab) for x in base]
            rng.shuffle(w)
            out.append((f"u{g}_{k}", " ".join(w[:20]).upper(), ", ".join(w[20:]), k, "clash"))
    out += [("copy1", "a b c", None, 0, None), ("copy2", "C, b; A!", "", 0, None), ("empty", None, None, 0, None), ("blank", " ", "...", 0, None), (None, "a b c", None, 0, None)]
    return out + out[:5]


def test_pairs_equal_brute_force(spark, rows):
    got = {tuple(r) for r in p1.similar_pairs(spark.createDataFrame(rows, SCHEMA), "unit_id", ["summary", "verbatim_anchor"]).collect()}
    want = brute(rows)
    assert ("copy1", "copy2") in got
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_groups_follow_pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    g = {r["id"]: r["group_id"] for r in p1.similar_groups(df, "unit_id", ["summary", "verbatim_anchor"]).collect()}
    assert set(g) == {r[0] for r in rows if r[0]}
    for a, b in p1.similar_pairs(df, "unit_id", ["summary", "verbatim_anchor"]).collect():
        assert g[a] == g[b] <= a
    assert g["empty"] == "empty"


def test_keys_follow_the_number_of_records():
    of = p1.Tensor.for_records
    assert (of(80_000, 0.6).m, of(80_000, 0.6).k) == (14, 3)
    ks = [of(10**e, 0.6).k for e in range(3, 11)]
    assert ks == sorted(ks) and ks[-1] > ks[0]
    for e in range(3, 11):
        t = of(10**e, 0.6)
        assert (1 - (1 - 0.6**t.k) ** t.m) ** 2 >= 0.93 and 10**e * t.m**2 * 0.15 ** (2 * t.k) <= 1000


def test_classes_and_their_sizes(spark):
    df = spark.createDataFrame([("b", "one two three", None, 0, ""), ("a", "three, one two", None, 0, ""), ("c", "one two three four", "", 0, ""), ("d", None, None, 0, "")], SCHEMA)
    got = {r["id"]: (r["class_id"], r["class_size"], r["group_id"], r["links"]) for r in p1.similar_groups(df, "unit_id", ["summary", "verbatim_anchor"]).collect()}
    assert got == {"a": ("a", 2, "a", 1), "b": ("a", 2, "a", 1), "c": ("c", 1, "a", 1), "d": ("d", 1, "d", 0)}


def test_many_copies_are_stars(spark):
    df = spark.createDataFrame([(f"c{i:03d}", "one two three", None, i, "") for i in range(100)] + [("d", "one two three four", None, 0, "")], SCHEMA)
    got = {tuple(r) for r in p1.similar_pairs(df, "unit_id", ["summary", "verbatim_anchor"]).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 100)} | {("c000", "d")}


def test_long_text_and_empty_table(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    df = spark.createDataFrame([("a", long, None, 0, ""), ("b", long + " more", None, 0, "")], SCHEMA)
    assert [tuple(r) for r in p1.similar_pairs(df, "unit_id", ["summary", "verbatim_anchor"]).collect()] == [("a", "b")]
    none = df.filter("false")
    assert p1.similar_pairs(none, "unit_id", ["summary", "verbatim_anchor"]).count() == 0
    assert p1.similar_groups(none, "unit_id", ["summary", "verbatim_anchor"]).count() == 0


def test_different_texts_of_equal_words_meet_in_full(spark, monkeypatch):
    monkeypatch.setattr(p1, "PART_MEMBERS", 7)
    words = "one two three four five".split()
    rng = random.Random(4)
    texts = sorted({" ".join(rng.sample(words, 5)) for _ in range(200)})[:40]
    rows = [(f"v{i:02d}", t, None, i, "") for i, t in enumerate(texts)] + [(f"w{i:02d}", t + " six", "", i, "") for i, t in enumerate(texts[:35])]
    copies = [(f"x{i:02d}", "one two three four five SIX", None, i, "") for i in range(40)]
    got = {tuple(r) for r in p1.similar_pairs(spark.createDataFrame(rows + copies[:1] + rows[:3], SCHEMA), "unit_id", ["summary", "verbatim_anchor"]).collect()}
    assert got == brute(rows + copies[:1])
    got = {tuple(r) for r in p1.similar_pairs(spark.createDataFrame(rows + copies, SCHEMA), "unit_id", ["summary", "verbatim_anchor"]).collect()}
    assert got == brute(rows + copies[:1]) | {("x00", c[0]) for c in copies[1:]}


def test_keys_are_not_on_disk_all_at_once(spark):
    """625 table keys a record took 9 KB of it."""
    rng = random.Random(5)
    rows = [(f"d{i}", " ".join(f"w{x}" for x in rng.sample(range(5000), 30)), None, i, "") for i in range(3000)]
    df = spark.createDataFrame(rows + [("near", rows[7][1] + " more", None, 0, "")], SCHEMA)
    places = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    places.append(shared_dir(spark).removeprefix("file://"))

    def used():
        total = 0
        for at in (os.path.join(x, f) for p in places for x, _, fs in os.walk(p) for f in fs):
            try:
                total += os.path.getsize(at)
            except OSError:
                pass
        return total

    before, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], used())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = [tuple(r) for r in p1.similar_pairs(df, "unit_id", ["summary", "verbatim_anchor"], tensor=p1.Tensor(25, 4)).collect()]
    finally:
        over.set()
        watcher.join()
    assert got == [("d7", "near")]
    assert 0 < most[0] - before < 3000 * len(rows)


def test_blocks_of_keys_and_one_hot_key(monkeypatch):
    """Against each pair that meets, with a key of a third of the rows and blocks far smaller than that."""
    for name, value in (("BLOCK_ROWS", 8), ("HELD_PAIRS", 5), ("SIGN_ROWS", 7)):
        monkeypatch.setattr(p1, name, value)
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, 40)
    lists = [np.where(rng.random(40) < rng.choice([0.05, 0.3]), rng.integers(-(2**63), 2**63, 40), base).tolist() for _ in range(60)]
    t = p1.Tensor(3, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 160)), pa.array(lists, pa.list_(pa.int64()))], names=["cid", "hashes"])
    signed = pa.Table.from_batches(list(p1._signed(t)([batch.slice(0, 25), batch.slice(25)]))).to_pydict()
    ends = {c: np.frombuffer(r, np.uint32) for c, r in zip(signed["cid"], signed["rest"])}
    rows = sorted((i * 2**32 + (0 if c % 3 == 0 else a), c) for i in range(3) for c, a in zip(signed["cid"], signed[f"a{i}"]))
    sketch = {c: r[4 * (t.m + t.m % 2):] for c, r in zip(signed["cid"], signed["rest"])}
    least = int(0.7 * 12 - t.slack * (12 * 0.7 * 0.3) ** 0.5)

    def alike(a, b):
        x, y = (int.from_bytes(sketch[c], "little") for c in (a, b))
        return sum(x >> 2 * f & 3 == y >> 2 * f & 3 for f in range(12)) >= least

    want = {tuple(sorted((a, b))) for (k, a), (q, b) in combinations(rows, 2) if k == q and (ends[a][:3] == ends[b][:3]).any() and alike(a, b)}
    binary = {c: r for c, r in zip(signed["cid"], signed["rest"])}
    whole = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([c for _, c in rows]), pa.array([binary[c] for _, c in rows], pa.binary())], names=["key", "cid", "rest"])
    got = {p for b in p1._meeting(t, 0.6)([whole.slice(i, 5) for i in range(0, len(rows), 5)]) for p in zip(*b.to_pydict().values())}
    assert got == want and len(want) > 100
