"""Golden cases of the text and time functions."""

import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as tx
from quillstream.functions import timefns as tm
from quillstream.operators import captions as cp
from quillstream.sources import transcripts as tr


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("r")).first()["r"]


def test_clean_transcript(spark):
    clean = lambda t: one(spark, cp.clean_transcript(F.col("t")), t=t)
    assert clean("hello world") == "Hello world"
    assert clean("This is a test sentence\ntest sentence that overlaps") == "This is a test sentence that overlaps"
    out = clean("Um, hello.\nCan you hear me?\nThis is real content.")
    assert "This is real content" in out and "can you hear me" not in out.lower()
    assert clean("") == "" and clean(None) is None
    assert clean("[00:00:01] >> so, i dont know.  I DONT KNOW.\n[00:00:02] so, I dont know. Ok then. No.") == "I don't know. I DONT KNOW. Ok then. No."
    assert clean("A one. B two. C three. D four. E five.") == "A one. B two. C three. D four.\n\nE five."


def overlaps(lines, least=10):
    """By pairs: what a line brings beyond the last one that brought anything."""
    kept = []
    for line in filter(None, lines):
        whole = kept[-1][0] if kept else ""
        common = max((n for n in range(least, 1 + min(len(whole), len(line))) if whole[-n:] == line[:n]), default=0)
        new = line if whole in line else line[common:].strip()
        if line not in whole and new:
            kept = kept[: len(kept) - (whole in line)] + [(line, new)]
    return [new for _, new in kept]


def test_trim_overlaps(spark):
    rng = random.Random(6)
    words = "the gap fills before the close and the range holds".split()
    cases = [["abc", "abc", "abc def", "x"], [], ["", "a"], ["one two three", "two three", "zero one two three four"]]
    for _ in range(60):
        base = " ".join(rng.choice(words) for _ in range(30))
        cuts = sorted(rng.randint(0, len(base)) for _ in range(8))
        cases.append([base[max(0, a - rng.randint(0, 25)) : b + rng.randint(0, 20)] for a, b in zip(cuts, cuts[1:])])
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a array<string>").select("i", cp.trim_overlaps(F.col("a")).alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: overlaps(c) for i, c in enumerate(cases)}
    assert overlaps(cases[0]) == ["abc def", "x"]


def test_paragraphs(spark):
    of = lambda a: spark.createDataFrame([(a,)], "a array<string>").select(cp.paragraphs(F.col("a")).alias("r")).first()["r"]
    assert of(["a", "b", "c", "d", "e"]) == ["a b c d", "e"]
    assert of(["x" * 201, "y"]) == ["x" * 201, "y"]


def test_names_of_files_and_people(spark):
    assert str(one(spark, tx.date_in_name("n"), n="2023-05-08")) == "2023-05-08"
    assert str(one(spark, tx.date_in_name("n"), n="05_May_11_2023__Review_")) == "2023-05-11"
    assert [one(spark, tx.date_in_name("n"), n=n) for n in ("2023-13-08", "05_Foo_11_2023", "none", None)] == [None] * 4
    assert one(spark, tx.known_as("n", [("voice", "Lead")]), n=" A Voice ") == "Lead" and one(spark, tx.known_as("n", []), n="") == "unknown"
    assert one(spark, tx.four_part_stamp("n"), n="[00:00:33:04] [00:33:04]") == "[33:04] [00:33:04]"
    assert one(spark, tx.without_boilerplate("n"), n="Sure, here\n a\n **x**\nb") == " a\nb"


@pytest.mark.parametrize("url, yes", [("https://www.youtube.com/watch?v=abc", True), ("https://youtu.be/abc", True), ("https://example.com", False), (None, False)])
def test_video_url(spark, url, yes):
    assert one(spark, tx.is_video_url("u"), u=url) is yes


def test_names(spark):
    assert one(spark, tx.sanitize_filename("n"), n="test: file?.mp4") == "test_ file_.mp4"
    assert one(spark, tx.slugify("n"), n="https://Example.org/A-b?c=1") == "example_org_a_b_c_1"
    assert one(spark, tx.concept_stub("n"), n=" - ") == "unnamed_concept"
    assert one(spark, tx.match_name("n"), n="My_file-name.v2.mp4") == "my file name v2"
    assert one(spark, tx.video_id("n"), n="https://www.youtube.com/watch?v=abc&t=1") == "abc"
    assert one(spark, tx.capitalise("n"), n="iPhone x") == "IPhone x"
    assert one(spark, tx.paged_image("n"), n="/a/doc_p2_p013.png").asDict() == {"source": "doc_p2", "page": 13}
    assert one(spark, tx.paged_image("n"), n="x.png").asDict() == {"source": None, "page": None}


def test_sentences(spark):
    assert one(spark, tx.sentences("t"), t="One. Two!? Three") == ["One.", "Two!?", "Three"]
    assert one(spark, tx.sentences("t"), t="") == []
    assert one(spark, tx.sentences("t"), t=None) is None


def test_clock(spark):
    assert one(spark, tm.clock_to_seconds("t"), t="01:02:03") == 3723
    assert one(spark, tm.clock_to_seconds("t"), t="x") is None
    assert one(spark, tm.seconds_to_clock("t"), t=3723.9) == "01:02:03"
    assert one(spark, tm.seconds_to_clock("t"), t=360001) == "100:00:01"
    assert one(spark, tm.seconds_to_short_clock("t"), t=90061) == "1 day, 1:01:01"
    assert one(spark, tm.slide_seconds("t"), t="001_1.5.png") == 1.5
    assert one(spark, tm.slide_seconds("t", minutes=True), t="001_1.5.png") == 0.025
    assert one(spark, tm.slide_seconds("t"), t="001_final.png") is None


@pytest.mark.parametrize("text, s", [("00:01:25.205", 85.205), ("[00:01:25]", 85.0), (" 100:00:01 ", 360001.0), ("02:05", 125.0), ("00:00:01,5", 1.5), ("85s", 85.0), ("n/a", None), ("", None), (None, None), ("--:--", None)])
def test_offsets(spark, text, s):
    assert one(spark, tm.offset_seconds("t"), t=text) == s


def test_html():
    page = "<html><head><style>x</style></head><body><nav>menu</nav><article><h1>T</h1><p>A &amp; B</p><script>s</script></article><footer>f</footer></body></html>"
    assert tx.html_text(page) == "T\nA & B"
    assert tx.html_text("<p>only</p>") == "only"
    assert tx.html_text("") == ""


def test_indel_ratio():
    assert tx.indel_ratio("abc", "abc") == 100.0
    assert tx.indel_ratio("", "") == 100.0
    assert tx.indel_ratio("abcd", "abxd") == pytest.approx(75.0)


def test_vtt(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\n<c>short</c>\n\n00:00:01.000 --> 00:00:03.000\na &amp; longer\n\n00:00:05.000 --> 00:00:06.000\nlast\nline\n"
    df = spark.createDataFrame([(1, vtt), (2, "no captions"), (3, None)], "i int, t string")
    assert sorted(map(tuple, tr.vtt_cues(df, "i", "t").collect())) == [(1, 1, "a & longer"), (1, 5, "last line")]


def test_key_values(spark):
    assert one(spark, tr.key_values(F.col("t")), t="url: https://a.b/c\nno\ntitle: x: y\nurl: z") == {"url": "z", "title": "x: y"}
