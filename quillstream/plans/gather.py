"""Queries over names, answers of models, reviews and reports: what is gathered before and after the pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import rules
from quillstream.functions import text as tx
from quillstream.functions.timefns import seconds_to_clock, slide_seconds
from quillstream.operators import graph
from quillstream.operators import records as rc
from quillstream.operators import vectors as vx
from quillstream.operators import vocabulary as vc
from quillstream.plans import pipeline, records, vectors
from quillstream.plans.timeline import SLIDE_SQL
from quillstream.session import Scratch
from quillstream.sources import transcripts as tr
from quillstream.sources.tables import table


def _files(spark, d):
    return table(spark, d, "transcript_files").select("file_id", "stem", "video_id", "source_type", "profile", "session_date", "content", "ingested_at").dropDuplicates(["file_id"])


def _units(spark, d):
    return rc.distinct_units(table(spark, d, "knowledge_units"))


def _slides(spark, d):
    return table(spark, d, "img").select("slide_id", "video_id", "filename", "status", F.coalesce("seconds", slide_seconds("filename")).alias("t")).distinct()


def spoken_dates(spark, d):
    """Dates of names in both forms, and of names whose date is none."""
    f = _files(spark, d).filter("session_date is not null")
    spoken = F.concat(F.lit("05_"), F.date_format("session_date", "MMM_d_yyyy"), F.lit("__Review_"))
    name = F.when(F.col("file_id") % 3 == 0, spoken).when(F.col("file_id") % 3 == 1, F.replace(F.col("stem"), F.lit("-0"), F.lit("-3"))).otherwise(F.col("stem"))
    return f.select("file_id", tx.date_in_name(name).cast("string").alias("date"))


def long_enough_files(spark, d):
    """Files by the two least lengths that a text needs for notes and for units."""
    n = F.length(F.trim("content"))
    return _files(spark, d).groupBy("source_type").agg(F.count_if(n >= 100).alias("for_notes"), F.count_if(n >= 500).alias("for_units"), F.count("*").alias("n"))


def playlist_urls(spark, d):
    v = table(spark, d, "img").select("video_id").distinct()
    kind = F.ascii(F.right("video_id", F.lit(1))) % 4
    url = F.when(kind == 0, F.concat(F.lit("https://tube.example/watch?list="), "video_id")).when(kind == 1, F.concat(F.lit("https://tube.example/@"), "video_id")).when(kind == 2, F.concat(F.lit("https://tube.example/v/"), "video_id"))
    return v.select("video_id", tx.is_playlist(url).alias("playlist"))


def boilerplate_dropped(spark, d):
    """Answers of a model, made of texts, without the lines around them."""
    t = table(spark, d, "documents").filter("text is not null")
    said = F.concat(F.lit("Sure, as asked:\n"), "text", F.lit("\n  **Notes**\nGlossary of terms"))
    return t.select("doc_id", F.md5(tx.without_boilerplate(said)).alias("h"))


def notes_sources(spark, d):
    """Paths to make notes of, below folders of years, kinds and profiles."""
    f = _files(spark, d)
    folder = F.when(F.col("profile") == "qa", "Transcripts/Notes").when(F.col("profile") == "prose", "audio").otherwise("Transcripts")
    path = F.concat_ws("/", F.lit("library"), F.coalesce(F.year("session_date").cast("string"), F.lit("undated")), folder, F.concat("stem", F.when(F.col("file_id") % 5 == 0, ".md").otherwise(".txt")))
    return f.filter(tx.notes_source(path)).select("file_id", path.alias("path"))


def named_files(spark, d):
    """The first 20 files, by name, whose name has a word in it."""
    return _files(spark, d).filter(F.lower("stem").contains("review")).orderBy("stem").limit(20).select("file_id", "stem")


def speakers_known_as(spark, d):
    who = tx.known_as("provenance.speaker", [("voice_01", "Lead"), ("voice_02", "Second")])
    return _units(spark, d).groupBy(who.alias("speaker")).agg(F.count("*").alias("n"))


def lowest_content(spark, d):
    """The five frames of least content score."""
    return vectors.blank_rule(spark, d).orderBy("content_score", "vec_id").limit(5).select("vec_id", "content_score")


def latest_files(spark, d):
    """The last file that came in for each video."""
    f = _files(spark, d).filter("video_id is not null")
    return f.groupBy("video_id").agg(F.max_by("stem", F.struct("ingested_at", "file_id")).alias("stem"))


def kept_and_removed(spark, d):
    """Images of linked groups to be removed, beside the one that is kept."""
    p = table(spark, d, "duplicates").filter("is_duplicate").select(F.lower(F.trim("image1")).alias("u"), F.lower(F.trim("image2")).alias("v"))
    return graph.keep_first(graph.star_components(p.filter("u <> '' and v <> ''"), Scratch(spark, "kept")))


def deduplication_summary(spark, d):
    """What deduplication found in all: blank slides, groups, and slides that could go."""
    blank = table(spark, d, "img").select("slide_id", "status").distinct().agg(F.count_if(F.col("status") == "blank").alias("irrelevant"))
    groups = kept_and_removed(spark, d).agg(F.countDistinct("keep").alias("groups"), F.count("*").alias("removable"))
    # One row on either side.
    return blank.crossJoin(groups).select("irrelevant", "groups", (F.col("irrelevant") + F.col("removable")).alias("flagged"))


def reading_units(spark, d):
    """Readings of charts, as setups have them, as units."""
    u = _units(spark, d)
    steps = F.transform(F.coalesce("setup.sequence", F.array().cast("array<struct<order:int,action:string,position:string,range_liquidity:string,relative_to:string,zone_label:string>>")),
                        lambda s: F.struct(s["action"].alias("name"), s["position"].alias("description"), s["zone_label"].alias("risk_reward")))
    r = u.select(F.col("unit_id").alias("stem"), F.col("setup").isNotNull().alias("is_method"), F.coalesce("setup.name", "framework.method_name").alias("name"),
                 F.when(F.col("metadata.testability") == "not_testable", "other").otherwise(F.col("metadata.knowledge_type")).alias("framework"), F.col("metadata.concepts_canonical").alias("inferred"), steps.alias("mechanics"))
    return rc.reading_units(r)


def committed_reviews(spark, d):
    """Reviews that were approved, by where they go."""
    r = table(spark, d, "html_data").select("entry_id", F.when(F.col("is_key"), "approved").otherwise("pending").alias("status"), F.when(F.col("entry_type") == "transition", "journal").otherwise("unit").alias("target")).distinct()
    units, journal = rc.committed(r, "status", "target")
    return units.select("entry_id", F.lit("unit").alias("goes_to")).unionByName(journal.select("entry_id", F.lit("journal").alias("goes_to")))


def trimmed_answers(spark, d):
    """Summaries cut to the lengths that the ways of showing them allow."""
    return _units(spark, d).select("unit_id", *[F.md5(F.left("summary", F.lit(n))).alias(f"first_{n}") for n in (500, 300, 150, 120)])


def content_images(spark, d):
    """Images of pages that are content; of equal sources of a page, the first by position."""
    k = F.col("slide_id") % 6
    src = F.when(k == 0, F.lit("data:image/png;base64,x")).when(k == 1, F.concat(F.lit("/img/LOGO_"), "filename")).when(k == 2, F.lit("")).when(k == 3, F.lit("/img/cover.png")).otherwise(F.concat(F.lit("/img/"), "filename"))
    width = F.when(F.col("slide_id") % 7 == 0, "auto").otherwise((F.col("slide_id") % 311).cast("string"))
    i = table(spark, d, "img").select("slide_id", "video_id", "filename").distinct().withColumn("src", src)
    kept = i.filter(rules.content_image(F.col("src"), width, F.lit(None).cast("string"), F.col("slide_id") * 37 % 20000))
    first = kept.groupBy("video_id", "src").agg(F.min("slide_id").alias("slide_id"))
    return first.select("video_id", "src", "slide_id")


def stamp_variants(spark, d):
    """Malformed stamps set right, of both kinds."""
    clock = seconds_to_clock(F.col("event_id") % 360000)
    s = F.concat(F.lit("a ["), clock, F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("] b ["), clock, F.lit("]"))
    return table(spark, d, "events").select("event_id", tx.repair_stamp(s).alias("repaired"), tx.four_part_stamp(s).alias("shortened"))


def null_discipline(spark, d):
    """Share of a setup's fields left empty, and the figures that its texts claim."""
    fields = ["name", "regime_precondition", "bias_source", "timing_gate", "trigger", "entry", "invalidation", "target_logic", "management", "stop_philosophy", "quality_notes"]
    u = _units(spark, d).filter("setup is not null")
    values = F.array(*[F.nullif(F.coalesce(f"setup.{f}", F.lit("")), F.lit("")) for f in fields])
    empty = F.size(F.filter(values, lambda v: v.isNull()))
    return u.select("unit_id", F.round(empty / len(fields), 6).alias("empty"), tx.number_claims(F.concat_ws(" ", *[f"setup.{f}" for f in fields])).alias("claims"))


def variant_comparison(spark, d):
    """Variants side by side: units, average confidence, mapping rate and naming rate."""
    m = "metadata."
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rate = lambda a, b: F.round(a * 100.0 / F.greatest(b, F.lit(1)), 4)
    setups = F.count_if(F.col("setup").isNotNull())
    return _units(spark, d).groupBy(F.col(m + "testability").alias("variant")).agg(
        F.count("*").alias("units"), F.round(F.avg(F.coalesce(m + "extraction_confidence", F.lit(0.0))), 6).alias("confidence"),
        rate(F.sum(size(m + "concepts_canonical")), F.sum(size(m + "concepts_raw"))).alias("mapping_rate"), rate(F.count_if(F.col("setup.name").isNotNull()), setups).alias("naming_rate"),
        F.sum(size(m + "inferred_fields")).alias("inferred"))


def agreement_shares(spark, d):
    """Agreement of two runs in per cent, and the disagreements, field by field."""
    a = records.agreement_matrix(spark, d)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"same_{f}").alias("same")) for f in ("kind", "speaker", "testability")])
    return a.select("common", F.inline(fields)).select("field", F.round(F.col("same") * 100.0 / F.greatest("common", F.lit(1)), 4).alias("pct"), (F.col("common") - F.col("same")).alias("differ"))


def label_recall(spark, d):
    """Of a unit's known labels, the share that its reading has somewhere, and what it reads beside them."""
    empty = F.array().cast("array<string>")
    low = lambda c: F.transform(F.filter(F.coalesce(c, empty), lambda x: x.isNotNull()), F.lower)
    u = _units(spark, d).select("unit_id", low("metadata.concepts_raw").alias("read"), low(F.transform(F.coalesce("metadata.concepts_canonical", empty), lambda c: F.split_part(c, F.lit("_"), F.lit(1)))).alias("known"))
    hit = F.size(F.filter("known", lambda k: F.exists("read", lambda r: r.contains(k))))
    extra = F.size(F.filter("read", lambda r: ~F.exists("known", lambda k: r.contains(k)) & (F.length(r) > 2)))
    return u.select("unit_id", F.when(F.size("known") > 0, F.round(hit / F.size("known"), 6)).otherwise(1.0).alias("recall"), extra.alias("extra"))


def fabricated_steps(spark, d):
    """Readings with steps where neither of two other readings has any."""
    c = pipeline.element_counts(spark, d).join(_units(spark, d).filter("setup is not null").select("unit_id", F.coalesce(F.size("setup.reference_levels"), F.lit(0)).alias("n_levels")), "unit_id")
    flag = (F.col("n_seq") > 0) & (F.col("n_text") == 0) & (F.col("n_levels") == 0)
    return c.agg(F.count("*").alias("n"), F.count_if(flag).alias("fabricated"), F.round(F.count_if(flag) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("pct"))


def biggest_gainers(spark, d):
    return vc.top(records.gained_concepts(spark, d), "n", 10, "cid")


def topk_union_once(spark, d):
    """The top 3 of each query, united: of hits of equal label and distance, the first by query and rank."""
    e = vx.topk_each(table(spark, d, "embeddings"), "embedding", vectors._queries(spark, d), 3).select("query_id", "vec_id", "label", F.round("distance", 4).alias("distance"), "rank")
    w = Window.partitionBy("label", "distance").orderBy("query_id", "rank")
    return e.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def playlist_listing(spark, d):
    """Listings of playlists as JSON, read as rows."""
    v = table(spark, d, "img").select("video_id", "slide_id").distinct()
    entry = F.struct(F.when(F.col("slide_id") % 5 > 0, F.col("slide_id").cast("string")).alias("id"), F.when(F.col("slide_id") % 3 > 0, F.concat(F.lit("Part "), F.col("slide_id").cast("string"))).alias("title"))
    body = v.groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("entries"))).alias("body"))
    single = table(spark, d, "vocabulary").select(F.col("cid").alias("video_id"), F.to_json(F.struct(F.col("cid").alias("id"), F.col("label").alias("title"))).alias("body"))
    return tr.playlist_entries(body.unionByName(single), "video_id", "body").select(F.col("video_id").alias("listing"), "video", "title")


def keyframe_times(spark, d):
    """Times of key frames from a tool's lines; lines that are no number are skipped."""
    t = F.trim("timestamp")
    number = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    made = F.when(F.col("entry_id") % 2 == 0, (F.col("entry_id") / 4).cast("string")).otherwise(F.col("timestamp"))
    lines = table(spark, d, "html_data").select("entry_id", made.alias("timestamp")).distinct()
    return lines.select("entry_id", number.alias("t")).filter("t is not null")


def first_transcript_per_video(spark, d):
    """Of the files of a video, the one whose kind comes first, the first by name within it; notes are left out."""
    rank = F.array_position(F.array(*map(F.lit, ("transcript", "own_doc", "pdf"))), F.col("source_type"))
    f = _files(spark, d).filter(F.col("video_id").isNotNull() & ~F.col("stem").contains("notes")).withColumn("rank", rank).filter("rank > 0")
    w = Window.partitionBy("video_id").orderBy("rank", "stem")
    return f.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("video_id", "file_id")


def labelled_manifest(spark, d):
    """A list with labels and a list of pages without, as one; what has no label is to do."""
    named = table(spark, d, "vocabulary").select(F.col("cid").alias("path"), F.col("category").alias("true_kind"), F.lit("given").alias("label_source"))
    pages = table(spark, d, "img").filter("status = 'unique'").select(F.col("filename").alias("path")).distinct()
    return named.unionByName(pages, allowMissingColumns=True).select("path", F.coalesce("true_kind", F.lit("TODO")).alias("true_kind"), F.coalesce("label_source", F.lit("none")).alias("label_source"))


def dedup_results_json(spark, d):
    """Compared pairs as JSON objects, fields without value as nulls."""
    p = table(spark, d, "duplicates").select("image1", "image2", "is_duplicate", "score", "reason").distinct()
    return p.select(F.to_json(F.struct("image1", "image2", "is_duplicate", "score", "reason"), {"ignoreNullFields": "false"}).alias("row"))


def slide_report(spark, d):
    """A report of each video's slides in Markdown: a part for every slide, in their order."""
    s = _slides(spark, d).filter("t is not null").withColumn("n", F.row_number().over(Window.partitionBy("video_id", F.floor(F.col("t") / 3600)).orderBy("t", "slide_id")))
    part = F.concat(F.lit("## "), (F.floor(F.col("t") / 3600) + 1).cast("string"), F.lit("."), F.col("n").cast("string"), F.lit(" ("), seconds_to_clock("t"), F.lit(")\n\n![slide]("), "filename", F.lit(")\n"))
    return s.select("slide_id", part.alias("part"))


def vocabulary_domains(spark, d):
    """Terms and writings of each domain of the vocabulary."""
    return table(spark, d, "vocabulary").groupBy(F.col("category").alias("domain")).agg(F.count("*").alias("terms"), F.sum(F.coalesce(F.size("aliases"), F.lit(0))).alias("aliases"))


def crop_boxes(spark, d):
    """Crops of frames of 1280 x 720 by shares, some of them out of bounds."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.crop_box(
        F.lit(1280), F.lit(720), F.col("l_discount").cast("double") * 12 - 0.1, F.col("l_tax").cast("double") * 20 - 0.2, F.col("l_quantity").cast("double") / 40, F.col("l_tax").cast("double") * 15).alias("b"))
    return li.groupBy("b.x1", "b.y1", "b.x2", "b.y2").agg(F.count("*").alias("n"))


def images_before_paragraphs(spark, d):
    """Paragraphs of documents with the image placed before them, by the ids that documents give their images."""
    h = table(spark, d, "html_data").select("entry_id", "video_id", "entry_type", "text").distinct().filter("video_id is not null")
    p = h.select("video_id", "entry_id", F.when(F.col("entry_type") == "header", (F.col("entry_id") % 40).cast("string")).alias("rid"), "text")
    i = table(spark, d, "img").select("video_id", "slide_id", "filename").distinct().withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("slide_id")))
    rel = i.filter("n <= 40").select("video_id", (F.col("n") - 1).cast("string").alias("rid"), F.col("filename").alias("media"))
    return tr.with_image_before(p, rel, "video_id", "entry_id", "rid", "text").select("video_id", "entry_id", "image")


def nearest_measures(spark, d):
    """Of each compared pair, the hash by which it is nearest, and how near."""
    p = table(spark, d, "duplicates").select("image1", "image2", "distances", "compared_at").filter("image1 is not null and image2 is not null")
    p = p.withColumn("m", rules.nearest_measure(F.col("distances")))
    return p.groupBy(F.col("m.key").alias("measure"), F.col("m.value").alias("distance")).agg(F.count("*").alias("n"))


def allpairs_duplicate_decision(spark, d):
    """Frames compared with each other: pairs of near hashes, decided by distance, histogram and entropy.

    Pairs whose hashes differ by more than the loosest rule allows are no candidates, so none is near by its histogram
    alone; one_against_all has these.
    """
    rows = vectors._hashed(spark, d)
    near = vx.hamming_pairs(rows, "vec_id", "h", 18, extra=["embedding"])
    corr = vx.correlation(F.col("a_embedding"), F.col("b_embedding"))
    p = near.withColumn("hist", F.round(corr, 6)).withColumn("entropy", (F.col("a") % 8).cast("double"))
    r = vx.duplicate_decision(F.col("distance"), F.col("distance").cast("double"), F.col("hist"), F.col("entropy"), 12)
    return p.withColumn("r", r).filter("r.is_duplicate").select("a", "b", F.col("distance").cast("int").alias("distance"), "hist", F.col("r.reason").alias("reason"))


_F = "f as (select distinct on (file_id) * from transcript_files)"
_U = "u as (select distinct on (unit_id) * from knowledge_units where unit_id is not null)"
_CK = lambda s: f"printf('%02d:%02d:%02d', ({s})::bigint // 3600, ({s})::bigint // 60 % 60, ({s})::bigint % 60)"
_SETUP = ["name", "regime_precondition", "bias_source", "timing_gate", "trigger", "entry", "invalidation", "target_logic", "management", "stop_philosophy", "quality_notes"]
_GROUPS = """l as (select lower(trim(image1)) a, lower(trim(image2)) b from duplicates where is_duplicate and image1 is not null and image2 is not null),
  e as (select a, b from l where a <> b and a <> '' and b <> '' union select b, a from l where a <> b and a <> '' and b <> ''),
  r as (select a node, a reach from e union select r.node, e.b from r join e on e.a = r.reach), g as (select node, min(reach) keep from r group by 1)"""
_CLAIM = r"(?i)\b[0-9]{3,5}\b|\b[0-9]+\s*(point|pt|pip|%)\b"

QUERIES = {
    "spoken_dates": (spoken_dates, rf"""with {_F}, n as (select file_id, case when file_id % 3 = 0 then '05_' || strftime(session_date, '%b_%-d_%Y') || '__Review_' when file_id % 3 = 1 then replace(stem, '-0', '-3') else stem end as name from f where session_date is not null),
        x as (select *, regexp_extract(name, '[0-9]{{4}}[-_][0-9]{{2}}[-_][0-9]{{2}}') iso, regexp_extract(name, '[0-9]{{2}}_?([A-Za-z]{{3}}[_ ][0-9]{{1,2}}[_ ][0-9]{{4}})', 1) sp from n)
        select file_id, (case when iso <> '' then try_cast(replace(iso, '_', '-') as date) else try_strptime(replace(sp, '_', ' '), '%b %-d %Y')::date end)::varchar as "date" from x"""),
    "long_enough_files": (long_enough_files, f"with {_F} select source_type, count(*) filter (length(trim(content)) >= 100) for_notes, count(*) filter (length(trim(content)) >= 500) for_units, count(*) n from f group by 1"),
    "playlist_urls": (playlist_urls, "select distinct video_id, ascii(right(video_id, 1)) % 4 in (0, 1) playlist from img"),
    "boilerplate_dropped": (boilerplate_dropped, """with t as (select doc_id, string_split(text, chr(10)) a from documents where text is not null)
        select doc_id, md5(array_to_string(list_filter(a, lambda x: not regexp_matches(trim(x), '^(Here is|Sure|These are|\\*\\*|Glossary)')), chr(10))) h from t""".replace("\\\\", "\\")),
    "notes_sources": (notes_sources, f"""with {_F}, p as (select file_id, 'library/' || coalesce(year(session_date)::varchar, 'undated') || case profile when 'qa' then '/Transcripts/Notes/' when 'prose' then '/audio/' else '/Transcripts/' end || stem || case when file_id % 5 = 0 then '.md' else '.txt' end path from f)
        select file_id, path from p where path like '%.txt' and path like '%/Transcripts/%' and path not like '%/Notes/%' and path not like 'library/2023/%'"""),
    "named_files": (named_files, f"with {_F} select file_id, stem from f where contains(lower(stem), 'review') order by stem limit 20"),
    "speakers_known_as": (speakers_known_as, f"""with {_U} select case when coalesce(provenance.speaker, '') = '' then 'unknown' when contains(lower(provenance.speaker), 'voice_01') then 'Lead'
        when contains(lower(provenance.speaker), 'voice_02') then 'Second' else lower(trim(provenance.speaker)) end speaker, count(*) n from u group by 1"""),
    "lowest_content": (lowest_content, f"select vec_id, content_score from ({vectors.QUERIES['blank_rule'][1]}) order by content_score, vec_id limit 5"),
    "latest_files": (latest_files, f"with {_F} select video_id, arg_max(stem, (ingested_at, file_id)) stem from f where video_id is not null group by 1"),
    "kept_and_removed": (kept_and_removed, f"with recursive {_GROUPS} select keep, node \"remove\" from g where node <> keep"),
    "deduplication_summary": (deduplication_summary, f"""with recursive {_GROUPS}, b as (select count(distinct slide_id) filter (status = 'blank') irrelevant from img), k as (select count(distinct keep) groups, count(*) filter (node <> keep) removable from g)
        select irrelevant, groups, irrelevant + removable flagged from b, k"""),
    "reading_units": (reading_units, f"""with {_U}, r as (select unit_id stem, setup is not null m, coalesce(setup.name, framework.method_name) as name, case when metadata.testability = 'not_testable' then 'other' else metadata.knowledge_type end fw, metadata.concepts_canonical inf, setup.sequence sq from u)
        select stem, case when m then 'setup' else 'framework' end knowledge_type, case when m then 'partially' else 'not_testable' end testability, case when m then 0.7 else 0.6 end::double confidence,
        case when m then coalesce(nullif(name, ''), 'Chart setup: ' || stem) when fw <> 'other' and fw <> '' then fw || ' reference: ' || stem else coalesce(nullif(name, ''), 'Reference page: ' || stem) end summary,
        case when m then nullif(array_to_string(list_transform(coalesce(sq, []), lambda s: coalesce(s."action", '') || ': ' || coalesce(s."position", '') || ' (Risk: ' || coalesce(s.zone_label, '') || ')'), '; '), '') end entry,
        case when not m then nullif(array_to_string(inf[1:2], '; '), '') end answers from r"""),
    "committed_reviews": (committed_reviews, "select distinct entry_id, case when entry_type = 'transition' then 'journal' else 'unit' end goes_to from html_data where is_key"),
    "trimmed_answers": (trimmed_answers, f"with {_U} select unit_id, md5(left(summary, 500)) first_500, md5(left(summary, 300)) first_300, md5(left(summary, 150)) first_150, md5(left(summary, 120)) first_120 from u"),
    "content_images": (content_images, """with i as (select distinct slide_id, video_id, filename from img), s as (select *, slide_id % 6 k, case slide_id % 6 when 0 then 'data:image/png;base64,x' when 1 then '/img/LOGO_' || filename when 2 then '' when 3 then '/img/cover.png' else '/img/' || filename end src from i)
        select video_id, src, min(slide_id) slide_id from s where k >= 3 and (slide_id % 7 = 0 or slide_id % 311 >= 100) and slide_id * 37 % 20000 >= 8000
        and not regexp_matches(lower(src), 'logo|icon|avatar|sprite|pixel|spacer|banner|share|social|favicon|emoji') group by 1, 2"""),
    "stamp_variants": (stamp_variants, f"""with s as (select event_id, {_CK('event_id % 360000')} c, lpad((event_id % 60)::varchar, 2, '0') m from events) select event_id,
        case when length(c) = 8 then 'a [' || c || '] b [' || c || ']' else 'a [' || c || ':' || m || '] b [' || c || ']' end repaired, 'a [' || right(c, 2) || ':' || m || '] b [' || c || ']' shortened from s"""),
    "null_discipline": (null_discipline, f"""with {_U}, s as (select unit_id, [{', '.join(f"nullif(setup.{f}, '')" for f in _SETUP)}] v from u where setup is not null)
        select unit_id, round(len(list_filter(v, lambda x: x is null)) / {len(_SETUP)}, 6) empty, len(regexp_extract_all(array_to_string(list_filter(v, lambda x: x is not null), ' '), '{_CLAIM}'))::int claims from s"""),
    "variant_comparison": (variant_comparison, f"""with {_U} select metadata.testability variant, count(*) units, round(avg(coalesce(metadata.extraction_confidence, 0)), 6) confidence,
        round(sum(coalesce(len(metadata.concepts_canonical), 0)) * 100.0 / greatest(sum(coalesce(len(metadata.concepts_raw), 0)), 1), 4)::double mapping_rate,
        round(count(*) filter (setup.name is not null) * 100.0 / greatest(count(*) filter (setup is not null), 1), 4)::double naming_rate, sum(coalesce(len(metadata.inferred_fields), 0))::bigint inferred from u group by 1"""),
    "agreement_shares": (agreement_shares, f"""with a as ({records.QUERIES['agreement_matrix'][1]}), p as (select common, unnest([{{'f': 'kind', 's': same_kind}}, {{'f': 'speaker', 's': same_speaker}}, {{'f': 'testability', 's': same_testability}}]) x from a)
        select x.f field, round(x.s * 100.0 / greatest(common, 1), 4)::double pct, common - x.s differ from p"""),
    "label_recall": (label_recall, f"""with {_U}, x as (select unit_id, list_transform(list_filter(coalesce(metadata.concepts_raw, []), lambda c: c is not null), lambda c: lower(c)) rd,
        list_transform(coalesce(metadata.concepts_canonical, []), lambda c: lower(split_part(c, '_', 1))) kn from u)
        select unit_id, case when len(kn) > 0 then round(len(list_filter(kn, lambda k: len(list_filter(rd, lambda r: contains(r, k))) > 0)) / len(kn), 6) else 1 end::double recall,
        len(list_filter(rd, lambda r: length(r) > 2 and len(list_filter(kn, lambda k: contains(r, k))) = 0))::int extra from x"""),
    "fabricated_steps": (fabricated_steps, f"""with {_U}, c as (select coalesce(len(setup.sequence), 0) n, coalesce(len(setup.text_content.conditions), 0) + coalesce(len(setup.text_content.confluences), 0) + coalesce(len(setup.text_content.notes), 0) + coalesce(len(setup.text_content.other_text), 0) t,
        coalesce(len(setup.reference_levels), 0) v from u where setup is not null), k as (select count(*) n, count(*) filter (n > 0 and t = 0 and v = 0) fabricated from c) select n, fabricated, round(fabricated * 100.0 / greatest(n, 1), 4)::double pct from k"""),
    "biggest_gainers": (biggest_gainers, f"select cid, n from ({records.QUERIES['gained_concepts'][1]}) order by n desc, cid limit 10"),
    "topk_union_once": (topk_union_once, f"""with q as (select vec_id query_id, embedding q from embeddings where vec_id % 100 = 0), e as (select query_id, vec_id, label, 1 - {vectors._COS.format(a='embedding', b='q')} d from embeddings, q),
        r as (select *, row_number() over (partition by query_id order by d, vec_id)::int as "rank" from e where d is not null), t as (select query_id, vec_id, label, round(d, 4) distance, "rank" from r where "rank" <= 3),
        o as (select *, row_number() over (partition by label, distance order by query_id, "rank") rn from t) select query_id, vec_id, label, distance, "rank" from o where rn = 1"""),
    "playlist_listing": (playlist_listing, """select video_id listing, slide_id::varchar video, case when slide_id % 3 > 0 then 'Part ' || slide_id else 'Unknown' end title from (select distinct video_id, slide_id from img) where slide_id % 5 > 0
        union all select cid, cid, label from vocabulary"""),
    "keyframe_times": (keyframe_times, r"""with l as (select distinct entry_id, case when entry_id % 2 = 0 then (entry_id / 4)::varchar else "timestamp" end s from html_data) select entry_id, trim(s)::double t from l where regexp_matches(trim(s), '^[0-9]+(\.[0-9]+)?$')"""),
    "first_transcript_per_video": (first_transcript_per_video, f"""with {_F}, k as (select *, list_position(['transcript', 'own_doc', 'pdf'], source_type) rk from f where video_id is not null and not contains(stem, 'notes')),
        r as (select *, row_number() over (partition by video_id order by rk, stem) rn from k where rk > 0) select video_id, file_id from r where rn = 1"""),
    "labelled_manifest": (labelled_manifest, "select cid path, category true_kind, 'given' label_source from vocabulary union all select distinct filename, 'TODO', 'none' from img where status = 'unique'"),
    "dedup_results_json": (dedup_results_json, "select distinct to_json({'image1': image1, 'image2': image2, 'is_duplicate': is_duplicate, 'score': score, 'reason': reason})::varchar \"row\" from duplicates"),
    "slide_report": (slide_report, f"""with i as (select distinct slide_id, video_id, filename, status, {SLIDE_SQL} t from img), n as (select *, row_number() over (partition by video_id, floor(t / 3600) order by t, slide_id) n from i where t is not null)
        select slide_id, '## ' || (floor(t / 3600)::bigint + 1) || '.' || n || ' (' || {_CK('floor(t)')} || ')' || chr(10) || chr(10) || '![slide](' || filename || ')' || chr(10) part from n"""),
    "vocabulary_domains": (vocabulary_domains, "select category \"domain\", count(*) terms, sum(coalesce(len(aliases), 0))::bigint aliases from vocabulary group by 1"),
    "crop_boxes": (crop_boxes, """with p as (select l_discount::double * 12 - 0.1::double a, l_tax::double * 20 - 0.2::double b, l_quantity::double / 40 c, l_tax::double * 15 e from lineitem),
        s as (select *, least(greatest(trunc(1280 * a)::int, 0), 1279) x1, least(greatest(trunc(720 * b)::int, 0), 719) y1 from p)
        select x1, y1, least(greatest(trunc(1280 * c)::int, x1 + 1), 1280) x2, least(greatest(trunc(720 * e)::int, y1 + 1), 720) y2, count(*) n from s group by all"""),
    "images_before_paragraphs": (images_before_paragraphs, """with h as (select distinct entry_id, video_id, entry_type, text from html_data where video_id is not null), i0 as (select distinct video_id, slide_id, filename from img),
        i as (select *, row_number() over (partition by video_id order by slide_id) - 1 rid from i0), m as (select h.*, i.filename from h left join i on i.video_id = h.video_id and i.rid < 40 and h.entry_type = 'header' and i.rid = h.entry_id % 40),
        p as (select *, last_value(filename ignore nulls) over (partition by video_id order by entry_id) image from m) select video_id, entry_id, image from p where trim(coalesce(text, '')) <> ''"""),
    "nearest_measures": (nearest_measures, """with p as (select list_sort(list_transform(map_entries(distances), lambda e: {'value': e.value, 'key': e.key}))[1] m from duplicates where image1 is not null and image2 is not null)
        select m.key measure, m.value distance, count(*) n from p group by 1, 2"""),
    "allpairs_duplicate_decision": (allpairs_duplicate_decision, f"""with {vectors._HE}, c as (select a.vec_id a, b.vec_id b, bit_count(xor(a.h, b.h))::int distance, a.embedding ea, b.embedding eb, (a.vec_id % 8)::double entropy from he a join he b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 18),
        k as (select *, round({vectors.CORR_SQL.format(a='ea', b='eb')}, 6) hist, case when entropy < 4 then 9 when entropy > 7 then 15 else 12 end adj from c),
        m as (select *, distance <= adj and not (distance > adj and coalesce(hist, 0) < 0.85) x, coalesce(hist >= 0.9, false) y, coalesce(distance <= adj + 3 and hist >= 0.9::double - 0.05::double, false) z from k)
        select a, b, distance, hist, array_to_string(list_filter([case when x then 'Hash' end, case when y then 'Hist' end, case when z then 'AvgHash' end], lambda q: q is not null), '+') reason from m where x or y or z"""),
}
