"""Readers and writers of folders."""

from pyspark.sql import functions as F

from quillstream.sources import files


def test_jsonl_keeps_the_last_of_a_key(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.jsonl").write_text('{"id": "x", "v": 1}\n\n{"id": "y", "v": 2}\n{"id": "x", "v": 3}\n')
    got = files.jsonl_units(spark, [str(tmp_path / "a")], "id string, v int", key="id")
    assert sorted(map(tuple, got.collect())) == [("x", 3), ("y", 2)]
    assert files.jsonl_units(spark, [str(tmp_path / "a")], "id string, v int").count() == 3


def test_json_records_skip_errors(spark, tmp_path):
    for name, body in (("a.json", '{"v": 1}'), ("_b.json", '{"v": 2}'), ("c.json", '{"v": 3, "error": "x"}')):
        (tmp_path / name).write_text(body)
    assert [r["v"] for r in files.json_records(spark, str(tmp_path), "v int").collect()] == [1]


def test_listing_and_decoding(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    for name in ("a.MP4", "b.txt", "skip/c.mp4"):
        (tmp_path / name).write_bytes(b"xx")
    assert [r["name"] for r in files.listing(spark, str(tmp_path), files.MEDIA, ["skip"]).collect()] == ["a.MP4"]
    (tmp_path / "t").mkdir()
    for name, body in (("u8", "é".encode()), ("u16", "é".encode("utf-16")), ("l1", "é".encode("latin-1"))):
        (tmp_path / "t" / name).write_bytes(body)
    assert {r["text"] for r in files.decoded(spark, str(tmp_path / "t")).collect()} == {"é"}


def test_corpus_and_sinks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}.md").write_text(f"text {i}")
    assert [r["name"] for r in files.text_corpus(spark, str(tmp_path), "*.md", 2).collect()] == ["d0.md", "d1.md"]
    df = spark.range(10).withColumn("status", F.when(F.col("id") < 4, "unique").otherwise("blank"))
    files.write_by_status(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("status = 'unique'").count() == 4
    files.write_gated(df.withColumn("c", F.col("id") / 10.0), str(tmp_path / "gated"), "c")
    assert spark.read.json(str(tmp_path / "gated/held_back")).count() == 4
    assert files.write_versioned(df, str(tmp_path / "v"), 1).endswith("v000001")


def test_first_choice(spark):
    c = spark.createDataFrame([("a", "auto", 1), ("a", "manual", 2), ("b", "auto", 3)], "k string, kind string, n int")
    p = spark.createDataFrame([("manual", 0), ("auto", 1)], "kind string, rank int")
    assert sorted((r["k"], r["n"]) for r in files.first_choice(c, p, "k", "kind", "rank").collect()) == [("a", 2), ("b", 3)]


def test_versions_and_dry_runs(spark, tmp_path):
    df = spark.range(3)
    at = files.write_versioned(df, str(tmp_path / "t"), 1, dry_run=True)
    assert at.endswith("v000001") and not (tmp_path / "t").exists()
    assert files.write_versioned(df, str(tmp_path / "t"), 1) == at and spark.read.parquet(at).count() == 3


def test_first_choice(spark):
    have = spark.createDataFrame([("v", "any", "x"), ("v", "manual", "y"), ("w", "other", "z")], "video string, kind string, file string")
    want = spark.createDataFrame([("manual", 1), ("any", 2)], "kind string, rank int")
    assert [(r["video"], r["file"]) for r in files.first_choice(have, want, "video", "kind", "rank").collect()] == [("v", "y")]


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from quillstream import session

    scratch = session.Scratch(spark, "t")
    at = Path(scratch.cut(spark.range(2))._scratch_path.removeprefix("file:").replace("//", "/"))
    assert at.exists()
    session.clear_scratch(spark)
    assert not at.exists() and not at.parent.exists()
