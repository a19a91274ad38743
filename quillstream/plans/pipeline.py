"""Queries of the media and knowledge pipelines end to end: slides with text, units from segments, model stages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import image as im
from quillstream.functions import rules
from quillstream.functions import text as tx
from quillstream.functions.timefns import offset_seconds, seconds_to_clock, seconds_to_short_clock, slide_seconds
from quillstream.operators import captions as cp
from quillstream.operators import records as rc
from quillstream.operators import stages
from quillstream.operators import timeline as tl
from quillstream.plans.timeline import OFFSET_SQL, SLIDE_SQL
from quillstream.schemas import CLASSIFICATION
from quillstream.sources import transcripts as tr
from quillstream.sources.tables import table


def _files(spark, d):
    return table(spark, d, "transcript_files").filter("content is not null").dropDuplicates(["file_id"])


def slides_with_block_text(spark, d):
    """Each slide with the entries shown while it was on screen, in their order."""
    slides = table(spark, d, "img").select("slide_id", "video_id", F.coalesce("seconds", slide_seconds("filename")).alias("t")).distinct()
    blocks = table(spark, d, "html_data").select("entry_id", "video_id", offset_seconds("timestamp").alias("t"), "text").distinct().filter("t is not null and text is not null")
    j = tl.interval_join(slides, blocks.withColumn("lt", F.col("t")), "video_id", "t", "slide_id", ["entry_id", "lt", "text"])
    item = F.when(F.col("entry_id").isNotNull(), F.struct("lt", "entry_id", "text"))
    out = j.groupBy("slide_id", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"))
    return out.select("slide_id", seconds_to_short_clock("t").alias("at"), F.md5("text").alias("h"))


def units_from_segments(spark, d):
    """Five-minute segments of transcripts as units: id by ordinal before the length filter, summary, range."""
    s = tr.stamped_lines(_files(spark, d), "file_id", "content").withColumn("b", F.floor(F.col("seconds") / 300))
    seg = s.groupBy("file_id", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("seconds").alias("a"), F.max("seconds").alias("z"))
    from pyspark.sql import Window

    seg = seg.withColumn("o", F.row_number().over(Window.partitionBy("file_id").orderBy("b"))).filter(F.length(F.trim("text")) >= 40)
    seg = seg.join(_files(spark, d).select("file_id", "stem"), "file_id")
    return seg.select(rc.unit_id(F.col("stem"), F.lit(1), F.col("o")).alias("unit_id"), F.left("text", F.lit(160)).alias("summary"), F.concat(seconds_to_clock("a"), F.lit(" - "), seconds_to_clock("z")).alias("timestamp_range"))


def element_counts(spark, d):
    """Sequence steps and text elements of a setup, over its four text channels."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    u = rc.distinct_units(table(spark, d, "knowledge_units")).filter("setup is not null")
    t = "setup.text_content."
    return u.select("unit_id", n("setup.sequence").alias("n_seq"), (n(t + "conditions") + n(t + "confluences") + n(t + "notes") + n(t + "other_text")).alias("n_text"))


def grounding_status(spark, d):
    """What a reading of a chart claims against what it has: fabricated, over, under or right."""
    c = element_counts(spark, d)
    status = F.when((F.col("n_seq") > 0) & (F.col("n_text") == 0), "fabricated").when(F.col("n_seq") > F.col("n_text"), "over").when(F.col("n_seq") < F.col("n_text"), "under").otherwise("right")
    return c.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def quarantined_units(spark, d):
    """Units of a bad run, with less confidence and some without summary or type, that are held back, with the reason first
    in order."""
    k = F.ascii(F.right("unit_id", F.lit(1)))
    u = rc.distinct_units(table(spark, d, "knowledge_units"))
    u = u.withColumn("summary", F.when(k % 7 == 0, "").otherwise(F.col("summary"))).withColumn(
        "metadata", F.col("metadata").withField("extraction_confidence", F.col("metadata.extraction_confidence") - (k % 5) * 0.25).withField(
            "knowledge_type", F.when(k % 11 == 0, "riddle").when(k % 13 == 0, "tip").otherwise(F.col("metadata.knowledge_type"))))
    u = u.withColumn("v", rc.violations())
    low = F.coalesce(F.col("metadata.extraction_confidence"), F.lit(0.0)) < 0.35
    why = F.when(F.size("v") > 0, F.get("v", F.lit(0))).when(low, F.lit("low_confidence"))
    return u.select("unit_id", why.alias("reason")).filter("reason is not null")


def payload_fields(spark, d):
    """The payload as JSON, read again."""
    u = rc.distinct_units(table(spark, d, "knowledge_units")).withColumn("j", rc.payload_json())
    return u.select("unit_id", F.coalesce(F.get_json_object("j", "$.name"), F.get_json_object("j", "$.method_name"), F.get_json_object("j", "$.heuristic"), F.get_json_object("j", "$.principle")).alias("label"), rc.payload_label().alias("lead"))


def line_groups(spark, d):
    ln = tr.lines_of(_files(spark, d), "file_id", "content")
    return cp.line_groups(ln, "file_id", "line_no", "raw", 6).select("file_id", F.col("part").cast("int").alias("part"), F.md5("text").alias("h"))


def overlapping_chunks(spark, d):
    return _files(spark, d).select("file_id", F.posexplode(cp.overlapping_chunks(F.split("content", "\n"), 4000)).alias("pos", "c")).select("file_id", "pos", "c.start_ts", "c.end_ts", F.length("c.text").alias("n"))


def paragraphs_of_4(spark, d):
    p = cp.paragraphs(tx.sentences(F.col("text")))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(p).alias("pos", "p")).select("doc_id", "pos", F.md5("p").alias("h"))


def collapse_guard(spark, d):
    f = _files(spark, d)
    return f.select("file_id", cp.collapsed(F.length("content"), F.regexp_count("content", F.lit("\n")) / 100).alias("collapsed"))


def output_completeness(spark, d):
    """Logs of users as JSONL, some cut off."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), "\n").alias("t"))
    cut = F.when(F.col("user_id") % 3 == 0, F.left("t", F.length("t") - 2)).otherwise(F.col("t"))
    return e.select("user_id", cp.complete_output(cut).alias("complete"), cp.complete_notes(cut, 200).alias("notes"))


def batched_classification(spark, d):
    """Summaries in batches of 12 to a stub client, and its answers merged back by index."""
    u = rc.distinct_units(table(spark, d, "knowledge_units")).select("unit_id", F.col("provenance.source_file").alias("f"), "summary")
    b = rc.batches(u, "f", ["unit_id"], 12).withColumnRenamed("in_batch", "idx")
    asked = stages.ask(stages.numbered(b, ["f", "batch"], "idx", "summary"), "prompt", "answer", stages.stub_classifier)
    got = stages.classified(b, asked, ["f", "batch"], "idx", CLASSIFICATION)
    return got.select("unit_id", "item.knowledge_type", "item.testability", "item.extraction_worthwhile")


def embedded_summaries(spark, d):
    u = rc.distinct_units(table(spark, d, "knowledge_units")).select("unit_id", "summary")
    return stages.ask(u, "summary", "answer", stages.stub_embedder).select("unit_id", F.from_json("answer", "array<double>").alias("v")).select("unit_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@F.pandas_udf(T.BinaryType())
def _as_frame(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.repeat(np.clip((np.asarray(v) + 0.5) * 255, 0, 255).astype(np.uint8), 3).tobytes())


def _frames(spark, d):
    return table(spark, d, "embeddings").select("vec_id", _as_frame("embedding").alias("px"))


def frame_metrics(spark, d):
    m = _frames(spark, d).select("vec_id", im.frame_metrics("px", F.lit(8)).alias("m"))
    return m.select("vec_id", *[F.round(f"m.{c}", 4).alias(c) for c in im.METRICS])


def frame_hashes(spark, d):
    return _frames(spark, d).select("vec_id", im.frame_hashes("px", F.lit(8)).alias("h")).select("vec_id", "h.*")


def frame_crops(spark, d):
    """Content boxes, bars and dark borders of frames."""
    return _frames(spark, d).select("vec_id", im.frame_crops("px", F.lit(8)).alias("c")).select("vec_id", *[f"c.{f}" for f in ("x1", "y1", "x2", "y2", "bar_top", "bar_bottom")], F.round("c.dark_border", 6).alias("dark_border"))


def frames_like_the_first(spark, d):
    f = _frames(spark, d)
    f = f.withColumn("p0", F.lit(f.filter("vec_id = 0").first()["px"]))
    return f.select("vec_id", *[F.round(im.similarity(m)("px", F.lit(8), "p0", F.lit(8)), 6).alias(m) for m in ("ssim", "phash", "grid", "histogram")])


def legacy_slide_times(spark, d):
    i = table(spark, d, "img").select("slide_id", "filename").distinct()
    return i.select("slide_id", F.round(rules.legacy_seconds(F.col("filename")), 4).alias("s"))


def meeting_views(spark, d):
    """Frames told from conference views, with measures made of line items."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("faces"), (F.col("l_discount") * 6).alias("share"), (F.col("l_tax") * 2).alias("face"),
                                            (F.col("l_suppkey") % 2 == 0).alias("dark"), (F.col("l_extendedprice") / 8).alias("var"), (F.col("l_quantity") / 8).alias("ent"))
    r = rules.meeting_view(F.col("faces"), F.col("share"), F.col("face"), F.col("dark"), F.col("var"), F.col("ent"))
    return li.withColumn("r", r).groupBy("r.kind", "r.relevant", "r.confidence").agg(F.count("*").alias("n"))


def blank_confirmation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 / 1.0).alias("score"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 5).alias("blocks"), (F.col("o_custkey") % 4).alias("lines"))
    r = rules.confirmed_blank(F.col("score") < 10, F.col("score"), F.col("blocks"), F.when(F.col("blocks").isNotNull(), F.col("lines")))
    return o.withColumn("r", r).select("o_orderkey", "r.is_blank", "r.content_score")


def consensus_of_runs(spark, d):
    """Of each source, two runs with a label: how often they disagree, how often what they agree on is right, and how often
    a third run says setup."""
    k, kind = F.ascii(F.right("unit_id", F.lit(1))), F.col("metadata.knowledge_type")
    u = rc.distinct_units(table(spark, d, "knowledge_units")).select(F.col("provenance.source_type").alias("source"), kind.alias("truth"), F.when(k % 5 == 0, F.lit("setup")).otherwise(kind).alias("a"),
                                                                    F.when(k % 4 == 0, F.lit("tip")).otherwise(kind).alias("b"), F.when(k % 3 == 0, F.lit("setup")).otherwise(kind).alias("c"))
    agreed = rules.consensus([F.col("a"), F.col("b")])
    pct = lambda x, n: F.round(x * 100.0 / F.greatest(n, F.lit(1)), 4)
    return u.groupBy("source").agg(F.count("*").alias("n"), pct(F.count("*") - F.count(agreed), F.count("*")).alias("disagreement"),
                                   pct(F.count_if(agreed == F.col("truth")), F.count(agreed)).alias("accuracy"), pct(F.count_if(F.col("c") == "setup"), F.count("*")).alias("bias"))


def distance_limits(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 101 / 100.0).alias("s"))
    return e.select("event_id", rules.distance_limit(F.col("s")).alias("limit"))


_F = "f as (select distinct on (file_id) * from transcript_files where content is not null)"
_NL = "string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_LN = f"{_F}, ln as (select file_id, stem, unnest({_NL}) raw, generate_subscripts({_NL}, 1) - 1 line_no from f)"
_U = "u as (select distinct on (unit_id) * from knowledge_units where unit_id is not null)"
_EC = f"{_U}, c as (select unit_id, coalesce(len(setup.sequence), 0)::int n_seq, (coalesce(len(setup.text_content.conditions), 0) + coalesce(len(setup.text_content.confluences), 0) + coalesce(len(setup.text_content.notes), 0) + coalesce(len(setup.text_content.other_text), 0))::int n_text from u where setup is not null)"
_CK = lambda s: f"printf('%02d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60)"

_PX = """e as (select vec_id, unnest(embedding)::float x, generate_subscripts(embedding, 1) - 1 i from embeddings),
        px as (select vec_id, i // 8 r, i % 8 c, trunc(greatest(0::float, least(255::float, (x + 0.5::float) * 255::float)))::int g from e)"""
# A number of 64 bits, the first one the least, as a signed one.
_SIGNED = "(sum(case when {c} then 1::hugeint << ({i})::int else 0::hugeint end) - case when bool_or({c} and {i} = 63) then 1::hugeint << 64 else 0 end)::bigint"

QUERIES = {
    "slides_with_block_text": (slides_with_block_text, f"""with s0 as (select distinct slide_id, video_id, {SLIDE_SQL} t from img), s as (select *, lead(t) over (partition by video_id order by t, slide_id) nx from s0 where t is not null),
        b as (select distinct entry_id, video_id, {OFFSET_SQL} t, text from html_data where text is not null),
        j as (select s.slide_id, s.t, coalesce(string_agg(b.text, ' ' order by b.t, b.entry_id), '') x from s left join b on b.video_id = s.video_id and b.t >= s.t and (s.nx is null or b.t < s.nx) group by 1, 2)
        select slide_id, case when t >= 172800 then (t::bigint // 86400) || ' days, ' when t >= 86400 then '1 day, ' else '' end || printf('%d:%02d:%02d', floor(t)::bigint // 3600 % 24, floor(t)::bigint // 60 % 60, floor(t)::bigint % 60) as "at", md5(x) h from j"""),
    "units_from_segments": (units_from_segments, rf"""with {_LN}, st as (select *, regexp_extract(raw, '^\[(\d{{2}}:\d{{2}}:\d{{2}})\]\s*(.+)', 1) ts, regexp_extract(raw, '^\[(\d{{2}}:\d{{2}}:\d{{2}})\]\s*(.+)', 2) tx from ln where regexp_matches(raw, '^\[(\d{{2}}:\d{{2}}:\d{{2}})\]\s*(.+)')),
        se as (select *, split_part(ts, ':', 1)::int * 3600 + split_part(ts, ':', 2)::int * 60 + split_part(ts, ':', 3)::int sec from st),
        g as (select file_id, stem, sec // 300 b, string_agg(tx, ' ' order by line_no) t, min(sec) a, max(sec) z from se group by 1, 2, 3), o as (select *, row_number() over (partition by file_id order by b) o from g)
        select stem || '__01_' || printf('%02d', o) || '_' || left(sha1(stem || ':1:' || o), 10) unit_id, left(t, 160) summary, {_CK('a')} || ' - ' || {_CK('z')} timestamp_range from o where length(trim(t)) >= 40"""),
    "element_counts": (element_counts, f"with {_EC} select unit_id, n_seq, n_text from c"),
    "grounding_status": (grounding_status, f"with {_EC} select case when n_seq > 0 and n_text = 0 then 'fabricated' when n_seq > n_text then 'over' when n_seq < n_text then 'under' else 'right' end status, count(*) n from c group by 1"),
    "quarantined_units": (quarantined_units, f"""with {_U}, k as (select unit_id, ascii(right(unit_id, 1)) k, case when ascii(right(unit_id, 1)) % 7 = 0 then '' else summary end s, metadata.extraction_confidence - (ascii(right(unit_id, 1)) % 5) * 0.25::double c,
        case when ascii(right(unit_id, 1)) % 11 = 0 then 'riddle' when ascii(right(unit_id, 1)) % 13 = 0 then 'tip' else metadata.knowledge_type end t,
        list_filter([case when setup is not null then 'setup' end, case when contextual is not null then 'contextual' end, case when framework is not null then 'framework' end, case when tip is not null then 'tip' end, case when psychology is not null then 'psychology' end, case when anecdote is not null then 'anecdote' end], lambda x: x is not null) p from u),
        r as (select unit_id, case when len(p) <> 1 then 'payload_count' when p[1] is distinct from t then 'payload_type' when c < 0 or c > 1 then 'confidence_bounds' when coalesce(s, '') = '' then 'summary_missing'
          when coalesce(t not in ('setup', 'contextual', 'framework', 'tip', 'psychology', 'anecdote'), true) then 'unknown_type' when coalesce(c, 0) < 0.35 then 'low_confidence' end reason from k) select * from r where reason is not null"""),
    "payload_fields": (payload_fields, f"""with {_U} select unit_id, coalesce(setup.name, framework.method_name, tip.heuristic, psychology.principle) as "label",
        case when setup is not null then setup.name when contextual is not null then contextual.event_or_condition when framework is not null then framework.method_name when tip is not null then tip.heuristic when psychology is not null then psychology.principle when anecdote is not null then anecdote.embedded_heuristic end as "lead" from u"""),
    "line_groups": (line_groups, f"""with {_LN}, n as (select file_id, count(*) n from ln group by 1), p as (select file_id, line_no, raw, floor(line_no / greatest(1, n // 6))::int part from ln join n using (file_id))
        select file_id, part, md5(string_agg(raw, chr(10) order by line_no)) h from p group by 1, 2"""),
    "overlapping_chunks": (overlapping_chunks, None),
    "paragraphs_of_4": (paragraphs_of_4, None),
    "collapse_guard": (collapse_guard, f"with {_F} select file_id, length(content) > 15000 and (length(content) - length(replace(content, chr(10), ''))) / 100 < greatest(4, floor(length(content) / 8000)) collapsed from f"),
    "output_completeness": (output_completeness, """with t as (select user_id, string_agg(props, chr(10) order by event_id) t from events group by 1), c as (select user_id, case when user_id % 3 = 0 then left(t, length(t) - 2) else t end t from t)
        select user_id, strlen(t) >= 50 and json_valid(string_split(t, chr(10))[-1]) complete, strlen(t) >= 200 and not contains(left(t, 200), 'ERROR') notes from c"""),
    "batched_classification": (batched_classification, None),
    "embedded_summaries": (embedded_summaries, None),
    "legacy_slide_times": (legacy_slide_times, r"""with i as (select distinct slide_id, regexp_extract(filename, '_([0-9.]+)\.png', 1) r from img), v as (select *, try_cast(nullif(r, '') as double) v from i)
        select slide_id, round(coalesce(case when contains(r, '.') and v < 100 then try_cast(split_part(r, '.', 1) as int) * 60 + try_cast(nullif(regexp_extract(r, '([0-9]+)$', 1), '') as int) else v end, 0), 4) s from v"""),
    "meeting_views": (meeting_views, """with m as (select l_quantity::int % 5 faces, l_discount * 6 share, l_tax * 2 face, l_suppkey % 2 = 0 dark, l_extendedprice / 8 var, l_quantity / 8 ent from lineitem),
        p as (select *, ((dark and faces >= 2)::int * 4 + (var < 3000 and ent < 4 and faces >= 2)::int * 3 + (faces >= 3 and face < 0.08 and var < 5000)::int * 2
          + case when dark and var < 4000 and ent < 4.5 and var > 2000 then 1 when dark and var < 4000 and ent < 4.5 then 3 else 0 end + (share > 0.4 and faces >= 2)::int * 2)::int confidence from m),
        o as (select *, confidence >= 5 and var < 5000 or confidence >= 6 vc from p) select case when vc then 'video_conference' when dark and var > 2000 then 'slide_with_ui' else 'slide' end kind, not vc relevant, confidence, count(*) n from o group by 1, 2, 3"""),
    "blank_confirmation": (blank_confirmation, """with o as (select o_orderkey, (o_orderkey % 100)::double score, case when o_custkey % 3 > 0 then o_custkey % 5 end blocks, case when o_custkey % 3 > 0 then o_custkey % 4 end lines from orders),
        c as (select *, score < 25 cand, blocks is null and score > 5 unread, coalesce(blocks >= 3, false) or coalesce(lines > 1, false) saved from o)
        select o_orderkey, cand and not unread and not saved is_blank, case when cand and not unread and saved then greatest(score, 50) else score end content_score from c"""),
    "consensus_of_runs": (consensus_of_runs, f"""with {_U}, k as (select provenance.source_type source, metadata.knowledge_type t, ascii(right(unit_id, 1)) k from u),
        r as (select *, case when k % 5 = 0 then 'setup' else t end a, case when k % 4 = 0 then 'tip' else t end b, case when k % 3 = 0 then 'setup' else t end c from k)
        select source, count(*) n, round(count(*) filter (a <> b) * 100.0 / count(*), 4)::double disagreement, round(count(*) filter (a = b and a = t) * 100.0 / greatest(count(*) filter (a = b), 1), 4)::double accuracy,
        round(count(*) filter (c = 'setup') * 100.0 / count(*), 4)::double bias from r group by 1"""),
    "distance_limits": (distance_limits, "select event_id, greatest(2, trunc((1 - event_id % 101 / 100.0::double) * 60)::int)::int as \"limit\" from events"),
    "frame_metrics": (frame_metrics, f"""with {_PX}, m as (select vec_id, var_pop(g) v, stddev_pop(g) s, avg(g) a, min(g) lo, max(g) hi from px group by 1), c as (select vec_id, var_pop(g) v, stddev_pop(g) s, avg(g) a from px where r < 7 and c < 7 group by 1),
        h0 as (select vec_id, g, count(*) / 64.0::double p from px group by 1, 2), h as (select vec_id, -sum(p * log2(p)) e, max(p) * 100 d from h0 group by 1),
        b as (select px.vec_id, count(distinct case when hi = lo then 0 else least(31, (g - lo) * 32 // (hi - lo)) end) / 32.0::double u from px join m using (vec_id) group by 1)
        select m.vec_id, round(m.v, 4) variance, round(c.v, 4) variance_center, round(m.s, 4) std_dev, round(c.s, 4) std_dev_center, round(m.a, 4) mean_brightness, round(c.a, 4) mean_brightness_center, round(e, 4) entropy,
        round(u, 4) color_diversity, round(d, 4) dominant_intensity_percentage from m join c using (vec_id) join h using (vec_id) join b using (vec_id)"""),
    "frame_hashes": (frame_hashes, f"""with {_PX}, w as (select vec_id, r, c, g, avg(g) over v mean, quantile_cont(g, 0.5) over v med, lag(g) over (partition by vec_id, r order by c) before from px window v as (partition by vec_id)),
        f as (select k, y, sum(cos(pi() * k * (2 * (4 * y + j) + 1) / 64)) b from range(8) x(k), range(8) y(y), range(4) z(j) group by 1, 2),
        l as (select vec_id, a.k * 8 + b.k i, sum(g * a.b * b.b) v from px join f a on a.y = r join f b on b.y = c group by 1, 2), q as (select vec_id, quantile_cont(v, 0.5) filter (i > 0) med from l group by 1),
        p as (select vec_id, {_SIGNED.format(c="v > med", i="i")} phash from l join q using (vec_id) group by 1),
        o as (select vec_id, {_SIGNED.format(c="g > before", i="r * 8 + c")} dhash, {_SIGNED.format(c="g > mean", i="r * 8 + c")} ahash, {_SIGNED.format(c="g > med", i="r * 8 + c")} whash from w group by 1)
        select vec_id, phash, dhash, ahash, whash from p join o using (vec_id)"""),
    "frame_crops": (frame_crops, None),
    "frames_like_the_first": (frames_like_the_first, None),
}
