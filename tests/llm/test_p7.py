import heapq
import random
from collections import Counter
from fractions import Fraction

import pytest

from quillstream.llm.p7_mix import Mix, sainte_lague, seat

TARGETS = "source string, target_share double, max_repeats int"


def dealt(weights, caps, seats):
    out = [0] * len(weights)
    q = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(q)
    for _ in range(seats):
        if not q:
            break
        _, i = heapq.heappop(q)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(q, (-weights[i] / (2 * out[i] + 1), i))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_apportionment_equals_dealing_one_by_one(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    weights, caps, seats = [rng.choice([0, rng.random(), 0.25]) for _ in range(n)], [rng.choice([0, rng.randint(0, 40), 10**6]) for _ in range(n)], rng.randint(0, 300)
    assert sainte_lague(weights, caps, seats) == dealt(weights, caps, seats)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["plan", "trade", "open", "close"]) for _ in range(rng.randint(1, 200))), rng.choice(["a", "a", "a", "a", "b", "c", None, "other"]), "x") for i in range(1200)]
    return spark.createDataFrame(rows + [(5000, None, "a", "x"), (5001, "", "b", "x")] + rows[:10], "doc_id bigint, text string, source string, times string")


def times(rows):
    return Counter((r["doc_id"], r["source"]) for r in rows)


def test_shares_and_repeats(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.1, 2)], TARGETS)
    mix = Mix(docs, targets, block_tokens=64, shard_tokens=5000)
    rows = mix.placements().collect()
    assert len({(r["doc_id"], r["repeat"]) for r in rows}) == len(rows)
    most = {"a": 1, "b": 3, "c": 2}
    assert all(n <= most[s] for (_, s), n in times(rows).items())
    shares = {r["source"]: r for r in mix.shares().collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[s]["reached_share"] - want) < 0.02
    assert shares["gone"]["tokens"] == 0
    assert sum(r["tokens"] for r in shares.values()) == sum(r["n_tokens"] for r in rows)
    assert sum(r["docs"] for r in shares.values()) == len({r["doc_id"] for r in rows})
    quotas = mix.shard_quotas().collect()
    total = {r["source"]: 0 for r in quotas}
    for r in quotas:
        assert r["blocks"] >= 0
        total[r["source"]] += r["blocks"]
    assert total == {r["source"]: r["quota"] for r in mix.quota.collect()}


def test_each_shard_takes_its_quota(spark):
    """Every document is one block, so the placements of a shard of the mix are the blocks it took."""
    rows = [(i, " plan" * 64, s) for i, s in enumerate(["a"] * 500 + ["b"] * 90 + ["c"] * 37)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 6)], TARGETS)
    mix = Mix(docs, targets, block_tokens=64, shard_tokens=64 * 50)
    taken = mix.placements().collect()
    got = Counter((r["mix_shard"], r["source"]) for r in taken)
    want = {(r["mix_shard"], r["source"]): r["blocks"] for r in mix.shard_quotas().collect() if r["blocks"]}
    assert len({k for k, _ in want}) > 10 and got == want
    # A source of less than a round is served from all of its input, one of several rounds evenly.
    b = times(r for r in taken if r["source"] == "b")
    assert len(b) == 90 and max(b.values()) - min(b.values()) == 1


@pytest.mark.parametrize("seed", range(8))
def test_seats_are_the_order_of_dealing(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    weights, caps = [rng.choice([0, 250_000, rng.randint(1, 10**6)]) for _ in range(n)], [rng.choice([0, rng.randint(1, 30)]) for _ in range(n)]
    blocks = [(q, i, weights[i]) for i in range(n) for q in range(caps[i]) if weights[i]]
    order = sorted(blocks, key=lambda b: (-Fraction(b[2], 2 * b[0] + 1), b[1]))
    got = spark.createDataFrame(blocks, "q long, i int, weight long").withColumn("seat", seat(weights, caps)).collect()
    assert [(r["q"], r["i"]) for r in sorted(got, key=lambda r: r["seat"])] == [b[:2] for b in order]
    assert sorted(r["seat"] for r in got) == list(range(len(blocks)))


def test_same_seed_same_mix(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    a, b, c = (sorted(map(tuple, Mix(docs, targets, seed=s, block_tokens=64).placements().collect())) for s in (1, 1, 2))
    assert a == b != c


def test_small_sources_reach_their_cap(spark, docs):
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.9, 1)], TARGETS)
    mix = Mix(docs, targets, block_tokens=64, total_tokens=10**9)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert shares["b"]["reached_share"] < 0.9
    assert all(r["repeat"] == 0 for r in mix.placements().collect())


def test_empty(spark, docs):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mix = Mix(docs.filter("false"), targets)
    assert mix.placements().count() == 0 and mix.shard_quotas().count() == 0
    assert mix.shares().collect()[0]["reached_share"] is None
    assert Mix(docs, targets.filter("false")).placements().count() == 0
