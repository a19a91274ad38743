import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import p8_stuffing as p8

NOUNS = "gap range swing target ledger wick basis tape filter close".split()
VERBS = "tests fades meets holds breaks clears".split()
KEYS = "coupon academy robot cheap bundle signals login".split()


def redundancy(text):
    return p8.redundancy(p8.segments(pa.array([text.lower()]))[0].to_pylist())


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before {rng.randint(1, 12)}:{rng.randint(10, 59)}, and then I look at a {rng.choice(NOUNS)}."


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(sentence(rng) for _ in range(rng.randint(3, 20))), "en", 0) for i in range(300)]
    rows += [(1000 + i, ", ".join(f"{rng.choice(KEYS[:3])} {rng.choice(KEYS)}" for _ in range(80)), "en", 0) for i in range(25)]
    rows += [(2000, "\n".join(f"https://{rng.choice(NOUNS)}.example/{k}" for k in range(30)), "en", 0), (2001, "#gap#range#swing #tape #close", None, 0), (2002, "Home > Gap > Range | Home > Tape | Shop > Wick > Basis | Home > Close", "en", 0)]
    rows += [(3000, "\n".join(f"- https://a.example/{k} : " + sentence(rng) for k in range(10)), "en", 0), (3001, (sentence(rng) + "\n") * 40, "en", 0), (3002, "Reviewed early gap, marked thin range, slept badly.\nNo trade Monday.", "en", 0)]
    rows += [(4000, None, "en", 0), (4001, "", "en", 0), (4002, " \n", "en", 0), (4003, (sentence(rng) + " ") * 3000, "en", 0)]
    rows += [(4004, " ".join(sentence(rng) for _ in range(10)) + " " + ", ".join(f"{rng.choice(KEYS[:3])} {rng.choice(KEYS)}" for _ in range(5)), "en", 0)]
    df = spark.createDataFrame(rows + rows[300:303], "doc_id bigint, text string, lang string, share int")
    return {r["id"]: r["stuffed"] for r in p8.score_stuffing(df).collect()}, {r["doc_id"] for r in p8.stuffed_pages(df).collect()}


def test_stuffed_are_found(scored):
    flags, found = scored
    assert found == {i for i, f in flags.items() if f}
    assert found == set(range(1000, 1025)) | {2000, 2001, 2002}


def test_blank_texts_are_left_out(scored):
    assert not {4000, 4001, 4002} & set(scored[0])


def test_empty_and_unseeded(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert p8.stuffed_pages(none).count() == 0
    plain = spark.createDataFrame([(1, "One sentence here.", "en"), (2, "www.a.example www.b.example", None)], "doc_id bigint, text string, lang string")
    assert [r["doc_id"] for r in p8.stuffed_pages(plain).collect()] == [2]


def test_every_document_teaches_the_words(spark):
    """Pages that a sample of 12,000 by the hash of their id would leave out: one that is a seed, two that mix the same keywords with a sentence, and a seed whose keywords no other text has."""
    rng = random.Random(9)
    texts = 14_000
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) >= int(1_000_000 * 0.95 * 12_000 / (texts + 24))
    out = [r["id"] for r in spark.range(100_000, 100_100).filter(h).limit(4).collect()]
    rows = [(i, " ".join(sentence(rng) for _ in range(4)), "en") for i in range(texts)]
    line = lambda words, n: ", ".join(f"{rng.choice(words[:3])} {rng.choice(words)}" for _ in range(n))
    rows += [(20_000 + i, line(KEYS, 40), "en") for i in range(20)]
    own, lone = "gutschein akademie roboter billig buendel".split(), "zuverka molotti penvaru quisto drabbel".split()
    rows += [(out[0], line(own, 30), "en"), (out[1], sentence(rng) + "\n" + line(own, 12), "en"), (out[2], sentence(rng) + "\n" + line(own, 12), "en"), (out[3], line(lone, 30), "en")]
    scores = {r["id"]: r for r in p8.score_stuffing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)).collect()}
    assert {i for i, r in scores.items() if r["stuffed"]} == set(range(20_000, 20_020)) | set(out)
    assert min(scores[i]["share"] for i in out) > 0.4


def test_repeated_keywords_and_short_texts_are_measured(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(sentence(rng) for _ in range(rng.randint(3, 20))), "en") for i in range(300)]
    rows += [(500 + i, f"Reviewed {rng.choice(NOUNS)} {i}, marked {rng.choice(NOUNS)}, {rng.choice(VERBS)} the {rng.choice(NOUNS)} at {rng.randint(1, 12)}:{rng.randint(10, 59)}", "en") for i in range(60)]
    rows += [(2000 + i, ", ".join(f"{rng.choice(KEYS[:3])} {rng.choice(KEYS)}" for _ in range(80)), "en") for i in range(25)]
    rows += [(1000, "cheap coupon bundle\n" * 300, "en"), (1001, "cheap coupon bundle\n" * 7, "de"), (1002, (sentence(rng) + "\n") * 300, "en"), (1003, "«" + sentence(rng) + "»\n" * 2, "en")]
    scores = {r["id"]: r for r in p8.score_stuffing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert {i for i, r in scores.items() if r["stuffed"]} == {1000, 1001} | set(range(2000, 2025))
    assert min(scores[i]["deviation"] for i in (1000, 1001)) > 4.5
    assert all(r["deviation"] is not None for r in scores.values())
    assert redundancy("x y. " * 3) == redundancy("x y.")


def test_no_bytes_are_left_out():
    rng = random.Random(11)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600))
    assert redundancy(body + "z" * 100) < redundancy(body)


def test_segments_and_sentence_ends():
    texts = ["One. Two!\nthree\n\n  four?  five-six \u00a0", "", "a b.\u2003C. www.x.example", "…", "\n"]
    cut, of = p8.segments(pa.array(texts))
    assert list(zip(of.tolist(), cut.to_pylist())) == [(0, "One."), (0, "Two!"), (0, "three"), (0, "four?"), (0, "five-six"), (2, "a b."), (2, "C."), (2, "www.x.example"), (3, "…")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["en"] * 5), pa.array([1] * 5), pa.array(texts)], names=["id", "lang", "size", "text"])
    got = pa.Table.from_batches(p8._measured(iter([batch]))).to_pylist()
    assert [r["ends"] for r in got] == [3 / 5, 0, 2 / 4, 0, 0] and got[4]["ratio"] is None
    assert [r["counts"] for r in got] == [[1, 1, 1, 1, 2], [], [2, 1, 0], [0], []]
    assert got[2]["sure"] == [0, 0, 13] and len(got[2]["others"]) == 3
