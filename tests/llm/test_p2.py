import random

from quillstream.llm import p2_components as p2

SCHEMA = "image1 string, image2 string, is_duplicate boolean, label string, id int"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, dup, *_ in rows:
        if dup and a and b:
            a, b = a.strip().lower(), b.strip().lower()
            if a and b and a != b:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {(find(x), x) for x in list(parent)}


def run(spark, rows, **kw):
    got = p2.duplicate_groups(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_hub_chains_and_dirt(spark):
    rng = random.Random(1)
    rows = [("Hub ", f"h{i:03d}", True, "x", i) for i in range(150)]
    rows += [(f"c{i:03d}", f"c{i + 1:03d}", True, None, i) for i in range(90)]
    rows += [(f"r{rng.randint(0, 80)}", f"r{rng.randint(0, 80)}\t", True, "y", i) for i in range(60)]
    rows += [("h001", "hub", True, "", 0), ("no", "way", False, "", 0), ("no", "idea", None, "", 0), (None, "a", True, "", 0), ("a", " ", True, "", 0), ("s", "S", True, "", 0)]
    assert run(spark, rows) == brute(rows)


def test_giant_longer_than_the_peeling(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", True, "", i) for i in range(60)] + [("n030", f"z{i}", True, "", i) for i in range(5)] + [("a", "n060", True, "", 0)]
    assert run(spark, rows, max_peel_rounds=3) == brute(rows)


def test_empty(spark):
    assert run(spark, [("a", "b", False, "", 0)]) == set()
