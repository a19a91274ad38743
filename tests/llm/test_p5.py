import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import p5_split as p5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r#é́", max_size=400), st.integers(1, 60), st.integers(1, 60), st.integers(0, 4))
def test_pieces_cover_and_fit(text, target, limit, lines):
    cuts = p5.split_text(text, target, limit, lines)
    assert "".join(text[b:e] for _, b, e in cuts) == text
    assert all(e - a <= limit for a, _, e in cuts)
    assert all(a <= b <= e for a, b, e in cuts)
    assert (len(cuts) > 1) == (len(text) > limit)


def test_natural_boundaries_and_overlap():
    text = "\n".join(f"[00:00:{i:02d}] line number {i} says something." for i in range(60))
    cuts = p5.split_text(text, 300, 500, 2)
    for (_, b0, e0), (a, b, _) in zip(cuts, cuts[1:]):
        assert e0 == b and text[b - 1] == "\n"
        assert text[a:b].count("\n") == 2
    assert all(200 < e - b < 420 for _, b, e in cuts)


def test_no_line_end_or_mark_is_parted():
    text = "a\r\n" * 50
    assert all(not (text[b - 1] == "\r" and text[b] == "\n") for _, b, _ in p5.split_text(text, 10, 12, 0)[1:])
    text = "é" * 100
    assert all(text[b] != "́" for _, b, _ in p5.split_text(text, 11, 13, 0)[1:])


def test_table(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(20000))
    rows = [(1, "p", long, "x"), (1, "p", long, "x"), (2, "p", "short", "x"), (3, "p", "", "x"), (4, "p", None, "x"), (5, None, "abc", "x"), (6, "none", long, "x"), (7, "zero", long, None)]
    items = spark.createDataFrame(rows, "file_id bigint, profile string, content string, piece string")
    limits = spark.createDataFrame([("p", 900, 2400, 1), ("zero", None, 0, None)], "profile string, target_segment_chars int, max_segment_chars int, segment_overlap_lines int")
    got = p5.split_items(items, limits).collect()
    by = {}
    for r in got:
        by.setdefault(r["file_id"], []).append(r)
    assert set(by) == {1, 2, 3, 5, 6, 7}
    assert "".join(r["piece"][r["overlap_chars"]:] for r in sorted(by[1], key=lambda r: r["piece_no"])) == long
    assert all(len(r["piece"]) <= 2400 for r in by[1]) and len(by[1]) == by[1][0]["n_pieces"] > 100
    assert [len(by[k]) for k in (2, 3, 5, 6, 7)] == [1] * 5
    assert p5.split_items(items.filter("false"), limits).count() == 0


@pytest.mark.parametrize("size", [1, 10, 11, 99])
def test_one_long_word(size):
    assert all(e - a <= 10 for a, _, e in p5.split_text("x" * size, 5, 10, 3))
