import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm import p3_canonical as p3

VOCAB = [("sweep_pylon", "Pylon Sweep", "c", ["pysw"]), ("cascade_ripple", "Ripple Cascade", "c", ["tambourine vortex", "cascade of the ripple"]), ("window_ripple", "Ripple Window", "c", None), ("hinge_ember", "Ember Hinge", "c", [])]


@pytest.mark.parametrize("phrase, cid", [
    ("Pylon Sweep", "sweep_pylon"), ("the pyloon sweep rule", "sweep_pylon"), ("PYSW", "sweep_pylon"), ("(pysw)", "sweep_pylon"), ("sweep - pylon", "sweep_pylon"),
    ("pylonsweep", "sweep_pylon"), ("PylonSweep", "sweep_pylon"), ("py1on 5weep", "sweep_pylon"), ("pylon sw33p", "sweep_pylon"), ("pylоn swеep", "sweep_pylon"), ("cascade of the rippl", "cascade_ripple"),
    ("tambourine vort.", "cascade_ripple"), ("rpple cscde", "cascade_ripple"), ("15m ripple window on NQ", "window_ripple"), ("émber hinge", "hinge_ember"),
    ("ripple sweep", "unmatched"), ("ripple habits", "unmatched"), ("coffee budget", "unmatched"), ("sweep", "unmatched"), ("?!", "unmatched"),
])
def test_phrases(mapped, phrase, cid):
    assert mapped[phrase] == cid


@pytest.fixture(scope="module")
def mapped(spark):
    phrases = [m.args[1] for m in ()] or [p for p, _ in test_phrases.pytestmark[0].args[1]]
    return run(spark, phrases)


def run(spark, phrases, vocab=VOCAB):
    units = spark.createDataFrame([(f"u{i}", ([p, p, None, " "],), "clash") for i, p in enumerate(phrases)], "unit_id string, metadata struct<concepts_raw:array<string>>, cid string")
    v = spark.createDataFrame(vocab, "cid string, label string, category string, aliases array<string>")
    rows = p3.map_concepts(units, v).collect()
    assert len(rows) == len(phrases)
    return {r["concept_raw"]: r["cid"] for r in rows}


def osa(a, b):
    """Edits with swaps of neighbours, by the whole table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_and_keys_equal_brute_force(spark):
    """Up to two edits are counted as they are, and all words within them share a key."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"abcd", "abdc", "badc", "x" * 30}
    pairs = [(a, b, osa(a, b)) for a in sorted(words) for b in sorted(words)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    col = F.col
    shared = F.arrays_overlap(p3.keys_of(col("a"), False, 30), p3.keys_of(col("b"), True, 30))
    got = df.select("a", "b", "d", p3.edits(col("a"), col("b")).alias("e"), shared.alias("shared"), p3.similarity(col("a"), col("b")).alias("sim")).collect()
    for r in got:
        assert r["e"] == r["d"] if r["d"] <= 2 else r["e"] is None or r["e"] >= 2, r
        assert r["shared"] or r["sim"] == 0, r


def test_torn_words_long_tokens_and_plurals(spark):
    """Letters apart in over eight tokens, torn words within longer phrases, tokens of 60 letters, plurals of short words."""
    long = "supercalibrated" * 4
    vocab = [*VOCAB, ("long", long, "c", None), ("jump_igloo", "Igloo Jump", "c", None)]
    want = {"p y l o n s w e e p": "sweep_pylon", "e m b e r h i n g e s": "hinge_ember", "my rip ple win dow on mondays and other days of the week": "window_ripple",
            "the igloo jumps rule": "jump_igloo", long[:30] + "x" + long[31:]: "long", long[:40] + long[41:]: "long", "ripple swe ep": "unmatched", "y" * 60: "unmatched"}
    assert run(spark, list(want), vocab) == want


def test_empty_tables_and_long_phrases(spark):
    assert run(spark, ["pylon sweep", "x" * 5000], vocab=[]) == {"pylon sweep": "unmatched", "x" * 5000: "unmatched"}
    assert run(spark, ["word " * 3000 + "pylon sweep"])["word " * 3000 + "pylon sweep"] == "sweep_pylon"
    units = spark.createDataFrame([("u", (None,)), ("v", ([],))], "unit_id string, metadata struct<concepts_raw:array<string>>")
    assert p3.map_concepts(units, spark.createDataFrame(VOCAB, "cid string, label string, category string, aliases array<string>")).count() == 0
