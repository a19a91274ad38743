"""Small fixtures of operators that SQL doesn't cover, with nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import image as im
from quillstream.operators import captions, folds, graph, matching, records, stages, timeline, vectors
from quillstream.session import Scratch
from quillstream.streaming.files import run_to_end


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_of_chains_cycles_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = dict(graph.star_components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.star_components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "t")).count() == 0


def test_joins_along_time(spark):
    slides = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), ("a", 5.0, 3), ("b", 2.0, 4), ("b", None, 5)], "k string, t double, sid int")
    lines = spark.createDataFrame([("a", 0.0, 10), ("a", 3.0, 11), ("a", 5.0, 12), ("b", 9.0, 13), ("c", 1.0, 14)], "k string, t double, lid int")
    assert rows(timeline.asof_backward(lines, slides, "k", "t", "lid", "sid").select("lid", "sid")) == [(10, None), (11, 1), (12, 3), (13, 4), (14, None)]
    assert rows(timeline.nearest(lines, slides, "k", "t", "lid", "sid").select("lid", "sid")) == [(10, 1), (11, 1), (12, 2), (13, 4), (14, None)]
    j = timeline.interval_join(slides, lines, "k", "t", "sid", ["lid"])
    assert rows(j.select("sid", "lid")) == [(1, 11), (2, None), (3, 12), (4, 13)]


def test_folds(spark):
    df = spark.createDataFrame([(["aa", "bb", "cccccc", "d"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(folds.greedy_chunks(F.col("a"), 5)).collect()] == [["aa\nbb", "cccccc", "d"], []]
    assert [r[0] for r in df.select(captions.paragraphs(F.col("a"), most=2)).collect()] == [["aa bb", "cccccc d"], []]
    one = spark.createDataFrame([("abcde",), ("",)], "t string")
    assert [r[0] for r in one.select(folds.fixed_chunks(F.col("t"), 2)).collect()] == [["ab", "cd", "e"], []]
    r = spark.createDataFrame([("k", 1, 1, 1.0), ("k", 2, 2, 5.0), ("k", 3, 3, 20.0), ("k", 4, 4, None)], "k string, o int, i int, v double")
    assert rows(folds.reference_dedup(r, "k", ["o"], "i", "v", 10.0)) == [("k", 1, 1, False), ("k", 2, 1, True), ("k", 3, 3, False), ("k", 4, 4, False)]


def test_overlapping_chunks(spark):
    lines = [f"[00:0{i}:00] {'x' * 20}" for i in range(8)]
    got = spark.createDataFrame([(lines,), (["short"],)], "a array<string>").select(captions.overlapping_chunks(F.col("a"), 100, 1)).collect()
    chunks = got[0][0]
    assert chunks[0]["start_ts"] == "00:00:00" and chunks[-1]["end_ts"] == "00:07:00"
    assert all(a["text"].split("\n")[-1] == b["text"].split("\n")[0] for a, b in zip(chunks, chunks[1:]))
    assert got[1][0][0]["text"] == "short" and got[1][0][0]["end_ts"] == "end"


@pytest.mark.parametrize("answer, want", [('{"a": 1}', '{"a": 1}'), ('<think>{x}</think>```json\n{"a": {"b": 2}}\n```', '{"a": {"b": 2}}'), ('[{"a": 1}]', '{"a": 1}'), ("none", None), ("", None), (None, None)])
def test_json_object(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "t string").select(records.json_object(F.col("t"))).first()[0] == want


def test_routing_and_merging(spark):
    kinds = ["setup", "psychology", "setup", "tip", "contextual", "setup"]
    u = spark.createDataFrame(list(enumerate(kinds)), "i int, kind string")
    b = {(r["i"]): (r["batch"], r["in_batch"]) for r in records.batches(u, "kind", ["i"], 2).collect()}
    assert (b[0], b[2], b[5]) == ((0, 0), (0, 1), (1, 0))
    asked = spark.createDataFrame([("g", i) for i in range(3)], "g string, idx int")
    answers = spark.createDataFrame([("g", 0, 0, "a"), ("g", 2, 1, "b"), ("g", 2, 2, "c"), ("g", 9, 3, "x"), ("g", None, 4, "y")], "g string, idx int, pos int, item string")
    assert rows(records.merge_batch(asked, answers, ["g"], "idx", "pos", "item").select("idx", "item")) == [(0, "a"), (1, None), (2, "c")]


def test_decision(spark):
    def decide(mn, av, hist, ent, thr=10):
        df = spark.createDataFrame([(float(mn), float(av), hist, ent)], "mn double, av double, h double, e double")
        return df.select(vectors.duplicate_decision(F.col("mn"), F.col("av"), F.col("h"), F.col("e"), thr).alias("r")).first()["r"]

    assert decide(2, 2, 0.95, 5.0)["is_duplicate"] and decide(2, 2, 0.95, 5.0)["reason"] == "Hash+Hist+AvgHash"
    assert decide(40, 40, 0.5, 5.0).asDict() == {"is_duplicate": False, "adjusted_threshold": 10, "reason": "None"}
    assert not decide(5, 30, 0.5, 5.0)["is_duplicate"]
    assert decide(None or 40, 40, None, 5.0)["is_duplicate"] is False
    assert decide(6, 6, 0.5, 3.0, 3)["adjusted_threshold"] == 5


def test_hamming_pairs_are_all(spark):
    rng = np.random.default_rng(1)
    h = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    h += [x ^ (1 << int(rng.integers(0, 62))) for x in h[:20]]
    got = {(r["a"], r["b"]) for r in vectors.hamming_pairs(spark.createDataFrame(list(enumerate(h)), "i int, h bigint"), "i", "h", 5).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if ((h[i] ^ h[j]) & (2**64 - 1)).bit_count() <= 5}


def test_best_title(spark):
    names = spark.createDataFrame([("big_red-house.mp4",), ("zzz",)], "n string")
    titles = spark.createDataFrame([("House Big Red", 1), ("house red big", 2), ("other", 3)], "t string, o int")
    assert rows(matching.best_title(names, titles, "n", "t", "o").select("n", "t")) == [("big_red-house.mp4", "House Big Red"), ("zzz", None)]


def test_images():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (100, 100, 3)).astype(np.uint8)
    white = np.full((100, 100, 3), 255, np.uint8)
    assert im.ssim(a, a) == pytest.approx(1.0) and im.ssim(a, white) < 0.9
    assert im.dhash(a) == im.dhash(a.copy()) and im.dhash(a) != im.dhash(255 - a)
    red, blue = np.zeros((10, 10, 3), np.uint8), np.zeros((10, 10, 3), np.uint8)
    red[..., 0], blue[..., 2] = 255, 255
    assert im.correlation(im.histogram(red), im.histogram(red)) == pytest.approx(1.0) and im.correlation(im.histogram(red), im.histogram(blue)) < 1.0
    assert im.metrics(white)["entropy"] == 0 and im.metrics(white)["dominant_intensity_percentage"] == 100
    box = np.zeros((60, 80, 3), np.uint8)
    box[20:40, 30:60] = 255
    x1, y1, x2, y2 = im.content_box(box)
    assert 28 <= x1 <= 31 and 18 <= y1 <= 21 and 59 <= x2 <= 62 and 39 <= y2 <= 42
    assert im.dark_border(box) == 1.0 and im.crop(100, 50, -1, 0, 2, 0.5) == (0, 0, 100, 25)
    assert im.grid_similarity(a, a) == 1.0 and im.bar_heights(np.zeros((100, 10, 3), np.uint8)) == (15, 14)


def test_stages(spark):
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) == 1:
            raise OSError
        return [p.upper() if p != "bad" else "" for p in prompts]

    assert stages.with_retries(flaky)(["a", "bad"]) == ["A", ""] and calls == [2, 2, 1]
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, p string")
    got = dict(stages.ask(df, "p", "a", stages.stub_embedder).select("i", "a").collect())
    assert got[1].startswith("[") and got[2] is None
    p = stages.Profiles(stages.Profile("a", ("x", "y"), {"s": "A"}), stages.Profile("b", ("y", "z"), {"s": "B", "t": "B"})).resolve("a+b")
    assert p.domains == ("x", "y", "z") and p.prompts == {"s": "A", "t": "B"}


def test_incremental_stream_takes_each_file_once(spark, tmp_path):
    src, scratch = str(tmp_path / "src"), Scratch(spark, "t")
    spark.range(3).write.parquet(src)
    s = spark.readStream.schema("id bigint").parquet(src)
    from quillstream.streaming.files import read_sink, resume

    out, state = scratch.path(), scratch.path()
    resume(s, out, state)
    spark.range(3, 5).write.mode("append").parquet(src)
    resume(s, out, state)
    assert rows(read_sink(spark, out, s.schema)) == [(i,) for i in range(5)]
    assert run_to_end(s, scratch, "all").count() == 5


def test_upsert_keeps_the_last(spark, tmp_path):
    from quillstream.streaming.events import compact, upsert, upserted

    at, kind = str(tmp_path / "t"), "k string, n int, v string"
    put = upsert(at, "k", "n")
    put(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 0, "w")], kind), 0)
    for _ in range(2):
        put(spark.createDataFrame([("a", 2, "z"), ("b", 0, "old")], kind), 1)
    assert rows(upserted(spark, at, "k", "n")) == [("a", 2, "z"), ("b", 1, "y")]
    compact(spark, at, "k", "n", 1)
    put(spark.createDataFrame([("b", 3, "new")], kind), 2)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v000001", "v000002"]
    assert rows(upserted(spark, at, "k", "n")) == [("a", 2, "z"), ("b", 3, "new")]


def test_joins_along_time_cross_stretches(spark, monkeypatch):
    """Slides and lines over many stretches, some of them empty, equal what one sort of each document gives."""
    import random

    from quillstream.operators import timeline as tl

    monkeypatch.setattr(tl, "STRETCH", 10.0)
    rng = random.Random(11)
    slides = [(k, round(rng.uniform(0, 400), 1), i) for i, k in enumerate(rng.choices("aaab", k=60))] + [("a", None, 900), (None, 1.0, 901)]
    slides += [("a", 55.5, 902), ("a", 55.5, 903)]
    lines = [(k, round(rng.uniform(-50, 500), 1), i) for i, k in enumerate(rng.choices("aabc", k=300))] + [("a", None, 1900), (None, 2.0, 1901)]
    s, l = spark.createDataFrame(slides, "k string, t double, sid bigint"), spark.createDataFrame(lines, "k string, t double, lid bigint")
    of = {k: sorted((t, i) for k2, t, i in slides if k2 == k and t is not None) for k in "abc"}
    timed = [(k, t, i) for k, t, i in lines if k and t is not None]
    got = {r["lid"]: r["sid"] for r in tl.asof_backward(l, s, "k", "t", "lid", "sid", 2.0).collect()}
    assert got == {i: max((x for x in of[k] if x[0] <= t + 2.0), default=(None, None))[1] for k, t, i in timed}
    got = {r["lid"]: r["sid"] for r in tl.nearest(l, s, "k", "t", "lid", "sid").collect()}
    assert got == {i: min(((abs(t - a), a, j) for a, j in of[k]), default=(0, 0, None))[2] for k, t, i in timed}
    for tail, head in ((None, False), (7.0, False), (None, True)):
        joined = tl.interval_join(s, l, "k", "t", "sid", ["lid"], tail, head).collect()
        want = set()
        for k, spans in of.items():
            for n, (a, j) in enumerate(spans):
                end = spans[n + 1][0] if n + 1 < len(spans) else a + tail if tail else float("inf")
                start = float("-inf") if head and n == 0 else a
                hits = [i for k2, t, i in timed if k2 == k and start <= t < end]
                want |= {(j, i) for i in hits or [None]}
        assert {(r["sid"], r["lid"]) for r in joined} == want and len(joined) == len(want)


def test_every_title_is_scored(spark):
    from quillstream.functions.text import indel_ratio
    from quillstream.operators.matching import best_title, nearest_title

    titles = ["bighouse", "pylon sweep", "ripple cascade", "xylem"]
    names = ["bighouses", "pylom sweap", "cascade-ripple", "unlike anything", "zylem"]
    t = spark.createDataFrame([(x, i) for i, x in enumerate(titles)], "title string, o int")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {r["name"]: r["title"] for r in best_title(n, t, "name", "title", "o").collect()}
    assert got == {"bighouses": "bighouse", "pylom sweap": "pylon sweep", "cascade-ripple": "ripple cascade", "unlike anything": None, "zylem": "xylem"}
    assert indel_ratio("bighouse", "bighouses") > 70
    assert {r["name"]: (r["title"], r["dist"]) for r in nearest_title(n, t, "name", "title").collect()}["zylem"] == ("xylem", 1)
    assert best_title(n, t.filter("false"), "name", "title", "o").filter("title is not null").count() == 0


def test_near_hashes_equal_all_pairs(spark):
    import random

    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(6)]
    h = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 22))) for b in base for _ in range(12)] + [base[0], base[0]]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    df = spark.createDataFrame(list(enumerate(signed)) + [(999, None)], "i int, h bigint")
    for most in (3, 14):
        got = {(r["a"], r["b"]): r["distance"] for r in vectors.hamming_pairs(df, "i", "h", most).collect()}
        want = {(i, j): (x ^ y).bit_count() for i, x in enumerate(h) for j, y in enumerate(h) if i < j and (x ^ y).bit_count() <= most}
        assert got == want
        refs = df.filter("i < 3")
        near = {r["i"] for r in vectors.near_references(df, refs, "i", "h", most).collect()}
        assert near == {i for i, x in enumerate(h) if any((x ^ y).bit_count() <= most for y in h[:3])}


def test_components_of_chains_and_stars(spark):
    from quillstream.operators.graph import keep_first, star_components
    from quillstream.session import Scratch

    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 40)] + [(700, 701), (701, 702), (702, 700), (9, 9), (None, 3)]
    got = {r["node"]: r["label"] for r in star_components(spark.createDataFrame(edges, "u int, v int"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(201)} | {500 + i: 500 for i in range(40)} | {700: 700, 701: 700, 702: 700}
    kept = keep_first(spark.createDataFrame(list(got.items()), "node int, label int"))
    assert kept.count() == len(got) - 3


def test_topk_of_many_queries(spark):
    from quillstream.operators import vectors as vx

    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)] + [(90, [0.0, 0.0, 0.0])], "vec_id bigint, v array<double>")
    queries = rows.filter("vec_id % 10 = 0").selectExpr("vec_id query_id", "v query")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vx.topk_each(rows, "v", queries, 3).collect()}
    want = {}
    for q in queries.filter("query_id < 90").collect():
        want |= {(q["query_id"], n + 1): r["vec_id"] for n, r in enumerate(vx.topk(rows, "v", q["query"], 3).collect())}
    assert len(want) == 12 and got == want
