import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import p6_encode as p6


@pytest.fixture(scope="module")
def reference():
    return p6._tokenizer(f"{p6.TOKENIZERS}/byte_bpe_50k.json")


TEXTS = [None, "", " ", "\n\n \t x", "don't we'll 's", "<|endoftext|> a", "a  b   c\r\n", "naïve café 東京 🇩🇪👩‍👩‍👧", "x" * 50_000, "a­​﻿", "\U0001faf8 ࡰ Ᲊ", "12345 1.5e10 ½", "tail  ", "\x1c\x1d\x85 "]


def test_ids_equal_the_tokenizer(spark, reference):
    rows = [(i, t, "keep", 1) for i, t in enumerate(TEXTS)] + [(1, "", "keep", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, ids int")
    got = {r["doc_id"]: r["ids"] for r in p6.encode_corpus(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids
    n = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in p6.count_tokens(df, keep=("source",)).collect()}
    assert n == {i: ("keep", len(v)) for i, v in got.items()}
    back = {r["doc_id"]: r["text"] for r in p6.decode_corpus(p6.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_every_block_size_gives_the_same(spark):
    df = spark.createDataFrame([(i, f"word{i} and some more words {i % 7}") for i in range(300)], "doc_id int, text string")
    a, b = (sorted(map(tuple, p6.encode_corpus(df, block_chars=n).collect())) for n in (200, 10**9))
    assert a == b and len(a) == 300


def test_words_of_every_plane(spark, reference):
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b {chr(c)}1  {chr(c)}" for c in points]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "text": texts}))
    got = df.select("i", p6.words_of(F.col("text"), f"{p6.TOKENIZERS}/byte_bpe_50k.json").alias("w")).collect()
    pre = reference.pre_tokenizer
    assert all(r["w"] == [texts[r["i"]][a:b] for _, (a, b) in pre.pre_tokenize_str(texts[r["i"]])] for r in got)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=40))
def test_random_texts(spark, reference, texts):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = {r["doc_id"]: r["ids"] for r in p6.encode_corpus(df).collect()}
    assert got == {i: reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert p6.encode_corpus(spark.createDataFrame([], "doc_id int, text string")).count() == 0
