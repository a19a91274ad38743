import random

from pyspark.sql import functions as F

from quillstream.llm import p4_nearest as p4

ROW = "side int, entity string, us bigint, id bigint"


def rows_of(left, right):
    us = lambda s: None if s is None else round(s * 1_000_000)
    return [(side, e, us(s), i) for side, rows in ((p4.LEFT, left), (p4.RIGHT, right)) for e, s, i in rows]


def stream(spark, path, *parts):
    """A stream of one micro-batch for each part, in their order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(path))


def brute(left, right, tol):
    out = {}
    for e, s, i in left:
        near = [(abs(t - s), j) for f, t, j in right if f == e and t is not None and abs(t - s) < tol]
        out[i] = min(near)[1] if near else None
    return out


def data():
    rng = random.Random(5)
    left = [(rng.choice("aab"), round(rng.uniform(0, 300), 3), i) for i in range(120)]
    right = [(rng.choice("aabc"), round(rng.uniform(0, 300), 3), 1000 + i) for i in range(60)]
    return left, right


def test_equals_brute_force(spark, tmp_path):
    left, right = data()
    right += [("a", 7.0, 2000), ("a", 7.0, 2001)]
    got = p4.match_nearest(spark, stream(spark, tmp_path / "s", rows_of(left + left[:9], right + right[:9])), 5.0).collect()
    assert len(got) == len(left)
    assert {x["left_id"]: x["right_id"] for x in got} == brute(left, right, 5.0)


def test_several_batches_out_of_order(spark, tmp_path):
    left, right = data()
    rows = rows_of(left, right)
    got = p4.match_nearest(spark, stream(spark, tmp_path / "s", rows[::3], rows[1::3], rows[2::3]), 5.0, delay_s=3600).collect()
    assert {x["left_id"]: x["right_id"] for x in got} == brute(left, right, 5.0)


def test_batches_in_order_let_rows_go_and_evict(spark, tmp_path):
    left, right = data()
    rows = sorted(rows_of(left, right), key=lambda r: r[2])
    join = p4.NearestJoin(spark, 5.0)
    got = join.run(stream(spark, tmp_path / "s", *(rows[i : i + 30] for i in range(0, 180, 30)))).collect()
    assert {x["left_id"]: x["right_id"] for x in got} == brute(left, right, 5.0)
    assert len(join.report) == 6 and all(r["late"] == 0 for r in join.report.values())
    assert sum(r["out"] for r in join.report.values()) > 90
    assert max(r["waiting"] + r["candidates"] for r in join.report.values()) < 30


def test_an_endless_entity_before_short_ones(spark, tmp_path):
    endless = rows_of([("live", 10.0 * k, k) for k in range(2000)], [("live", 10.0 * k + 1, 10_000 + k) for k in range(2000)])
    short = [rows_of([(f"v{v}", 10.0 * k, 50_000 + 100 * v + k) for k in range(30)], [(f"v{v}", 10.0 * k + 2, 90_000 + 100 * v + k) for k in range(30)]) for v in range(10)]
    join = p4.NearestJoin(spark, 5.0)
    got = join.run(stream(spark, tmp_path / "s", endless[:2000:2] + endless[2000::2], endless[1:2000:2] + endless[2001::2], *(sum(short[i : i + 2], []) for i in range(0, 10, 2)))).collect()
    assert sum(x["entity"] != "live" and x["right_id"] == x["left_id"] + 40_000 for x in got) == 300
    # The endless entity's second part is all behind its own clock: late, and counted.
    assert join.report[1]["late"] > 1900 and sum(r["late"] for n, r in join.report.items() if n != 1) == 0


def test_a_batch_run_again_gives_the_same(spark):
    left, right = data()
    rows = sorted(rows_of(left, right), key=lambda r: r[2])
    join = p4.NearestJoin(spark, 5.0)
    halves = [spark.createDataFrame(h, ROW) for h in (rows[:90], rows[90:])]
    for n, h in ((0, halves[0]), (1, halves[1])):
        join.advance(h, n)
    once = sorted(map(tuple, spark.read.parquet(join._at("out", 1)).collect()))
    join.advance(halves[1], 1)
    assert once and sorted(map(tuple, spark.read.parquet(join._at("out", 1)).collect())) == once


def test_replay_is_in_order_of_time(spark):
    left, right = data()
    join = p4.NearestJoin(spark, 5.0)
    got = join.run(p4.replay(spark, spark.createDataFrame(rows_of(left, right), ROW), join.scratch, 4)).collect()
    assert {x["left_id"]: x["right_id"] for x in got} == brute(left, right, 5.0)
    assert len(join.report) == 4 and all(r["late"] == 0 for r in join.report.values())


def test_empty_sides_and_limits(spark, tmp_path):
    got = p4.match_nearest(spark, stream(spark, tmp_path / "l", rows_of([("a", 1.0, 1)], [])), 5.0).collect()
    assert [(x["left_id"], x["right_id"]) for x in got] == [(1, None)]
    got = p4.match_nearest(spark, stream(spark, tmp_path / "l2", rows_of([("a", 10.0, 1), ("a", 20.0, 2)], [("a", 5.0, 7), ("a", 24.999, 8)])), 5.0).collect()
    assert {x["left_id"]: x["right_id"] for x in got} == {1: None, 2: 8}
    join = p4.NearestJoin(spark, 5.0)
    assert join.run(p4.replay(spark, spark.createDataFrame([], ROW), join.scratch)).collect() == []


def test_rows_without_time_or_entity_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 1), (None, 1.0, 2), ("a", None, 3), ("a", 2.0, None)], "entity string, s double, id bigint")
    assert p4.timed(df, F.col("entity"), F.col("s"), F.col("id")).count() == 1


def test_second_0(spark, tmp_path):
    left, right = [("a", 0.0, 1), ("a", 1.0, 2), ("b", 0.0, 3), ("c", 0.0, 4), ("c", 3.0, 5)], [("a", 2.0, 10), ("b", 0.0, 11), ("b", 4.0, 12), ("d", 0.0, 13)]
    got = p4.match_nearest(spark, stream(spark, tmp_path / "s", rows_of(left, right)), 5.0).collect()
    assert {x["left_id"]: (x["right_id"], x["distance_us"]) for x in got} == {1: (10, 2_000_000), 2: (10, 1_000_000), 3: (11, 0), 4: (None, None), 5: (None, None)}
