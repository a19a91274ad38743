"""Queries over the star schema and the media tables: distributions, sets, totals, and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions.text import byte_size
from quillstream.functions.timefns import slide_seconds
from quillstream.operators.graph import star_components
from quillstream.operators.matching import best_title, nearest_title
from quillstream.operators.vocabulary import with_share
from quillstream.session import Scratch
from quillstream.sources.tables import table


def pct_distribution(spark, d):
    return with_share(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))


def event_type_stats(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count_if(F.col("value") < 20) / F.count("*"), 6).alias("below"), F.round(F.percentile("value", 0.5), 6).alias("median"))


def crop_union_percentiles(spark, d):
    """The union of boxes without their outer twentieths, in whole pixels."""
    li = table(spark, d, "lineitem")
    p = lambda c, q: F.percentile(F.col(c), q).cast("int")
    return li.groupBy("l_returnflag").agg(p("l_quantity", 0.05).alias("x1"), p("l_extendedprice", 0.05).alias("y1"), p("l_quantity", 0.95).alias("x2"), p("l_extendedprice", 0.95).alias("y2"))


def mean_ratios(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(*[F.round(F.avg(c), 6).alias(a) for c, a in (("l_discount", "left"), ("l_tax", "top"), ("l_quantity", "right"), ("l_extendedprice", "bottom"))])


def run_summary(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("success"), F.count_if(s == "O").alias("skipped"), F.count_if(s == "P").alias("failed"))


def cleanup_totals(spark, d):
    """Transcripts by kind, with their number, their bytes, and these in steps of 1024."""
    f = table(spark, d, "transcript_files").select("file_id", "source_type", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size")).dropDuplicates(["file_id"])
    t = f.groupBy("source_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return t.withColumn("s", byte_size("bytes")).select("source_type", "files", "bytes", F.col("s.value").alias("size"), F.col("s.unit").alias("unit"))


def project_flags(spark, d):
    """What each video has: slides, entries, duplicates found among its images, transcript."""
    parts = [table(spark, d, "img").select("video_id", F.lit("images").alias("k")), table(spark, d, "html_data").select("video_id", F.lit("entries").alias("k")),
             table(spark, d, "transcript_files").select("video_id", F.lit("transcript").alias("k")),
             table(spark, d, "duplicates").select(F.regexp_extract("path1", "^videos/([^/]+)/", 1).alias("video_id"), F.lit("dedup").alias("k"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).filter("video_id is not null and video_id <> ''")
    return u.groupBy("video_id").agg(*[F.bool_or(F.col("k") == k).alias(f"has_{k}") for k in ("images", "entries", "dedup", "transcript")])


def _dups(spark, d):
    return table(spark, d, "duplicates").filter("is_duplicate").select(F.lower(F.trim("image2")).alias("filename")).filter("filename is not null").distinct()


def unique_set(spark, d):
    """Slides that are neither blank nor the second of a duplicate pair."""
    i = table(spark, d, "img").select("slide_id", "filename", "status").distinct()
    return i.filter(F.coalesce("status", F.lit("")) != "blank").join(_dups(spark, d), "filename", "left_anti").select("slide_id")


def item_status(spark, d):
    """Blank before discard before keep."""
    i = table(spark, d, "img").select("slide_id", "filename", "status").distinct()
    j = i.join(_dups(spark, d).withColumn("dup", F.lit(True)), "filename", "left")
    return j.select("slide_id", F.when(F.coalesce("status", F.lit("")) == "blank", "blank").when(F.col("dup"), "discard").otherwise("keep").alias("item"))


def kept_set_deltas(spark, d):
    """Two runs of deduplication: what only the one, only the other, and both keep."""
    i = table(spark, d, "img").select("slide_id", "status").distinct()
    old = i.filter("status = 'unique'").select("slide_id")
    new = i.filter("slide_id % 3 <> 0").select("slide_id")
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "slide_id")
    return tag(old.subtract(new), "old").unionByName(tag(new.subtract(old), "new")).unionByName(tag(old.intersect(new), "both")).groupBy("part").agg(F.count("*").alias("n"))


def resume_anti_join(spark, d):
    """Files of transcripts that no knowledge unit came from yet."""
    done = table(spark, d, "knowledge_units").select(F.col("provenance.source_file").alias("stem")).distinct()
    return table(spark, d, "transcript_files").select("stem").distinct().join(done, "stem", "left_anti")


def keep_semi_join(spark, d):
    kept = table(spark, d, "img").filter("status = 'unique'").select("video_id").distinct()
    return table(spark, d, "html_data").filter("video_id is not null").select("entry_id", "video_id").distinct().join(kept, "video_id", "left_semi").select("entry_id")


def multi_source_union_collisions(spark, d):
    """Names that occur in more than one source."""
    n = table(spark, d, "nation").select(F.lower("n_name").alias("name"), F.lit("nation").alias("src"))
    r = table(spark, d, "region").select(F.lower("r_name").alias("name"), F.lit("region").alias("src"))
    p = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("name"), F.lit("customer").alias("src"))
    s = table(spark, d, "events").select(F.lower("event_type").alias("name"), F.lit("events").alias("src"))
    v = table(spark, d, "img").select(F.lower("video_id").alias("name"), F.lit("img").alias("src"))
    h = table(spark, d, "html_data").select(F.lower("video_id").alias("name"), F.lit("html").alias("src"))
    u = n.unionByName(r).unionByName(p).unionByName(s).unionByName(v).unionByName(h).filter("name is not null").distinct()
    return u.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("sources")).filter("n > 1")


def group_flatten_first_image_text(spark, d):
    """Slides of five-minute groups; a group's text goes to its first slide that wasn't removed."""
    from pyspark.sql import Window

    i = table(spark, d, "img").select("slide_id", "video_id", "filename", "status", F.coalesce("seconds", slide_seconds("filename")).alias("t")).distinct().filter("t is not null")
    kept = i.filter(F.coalesce("status", F.lit("")) != "blank").withColumn("b", F.floor(F.col("t") / 300))
    rn = F.row_number().over(Window.partitionBy("video_id", "b").orderBy("t", "slide_id"))
    kept = kept.withColumn("rn", rn)
    return kept.select("slide_id", F.when(F.col("rn") == 1, F.concat("video_id", F.lit("#"), F.col("b").cast("string"))).otherwise(F.lit("")).alias("text"))


def duplicate_components(spark, d):
    """Groups of linked images with their earliest name, and how many beside it could go."""
    p = table(spark, d, "duplicates").filter("is_duplicate").select(F.lower(F.trim("image1")).alias("u"), F.lower(F.trim("image2")).alias("v"))
    g = star_components(p.filter("u <> '' and v <> ''"), Scratch(spark, "dups"))
    return g.groupBy(F.col("label").alias("keep")).agg((F.count("*") - 1).alias("flagged"))


def fuzzy_best_match(spark, d):
    titles = table(spark, d, "vocabulary").select("label", F.crc32("label").alias("o"))
    names = table(spark, d, "html_data").filter("section is not null").select("section").distinct()
    return best_title(names, titles, "section", "label", "o", 70.0).select("section", "label", F.round("score", 4).alias("score"))


def levenshtein_matches(spark, d):
    """Sections and the label nearest by edit distance."""
    return nearest_title(table(spark, d, "html_data").select("section"), table(spark, d, "vocabulary").select("label"), "section", "label")


def size_reduction(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_linestatus").agg(F.round((1 - F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")) * 100, 4).alias("pct"))


def local_supplier_volume(spark, d):
    """A star join: revenue by nation of customers and suppliers of the same nation."""
    t = lambda n: table(spark, d, n)
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_ST = r"coalesce(seconds, try_cast(nullif(regexp_extract(filename, '_([0-9]+(?:\.[0-9]+)?)\.png$', 1), '') as double))"
_I = "i as (select distinct slide_id, filename, status from img)"
_D = "dd as (select distinct lower(trim(image2)) filename from duplicates where is_duplicate and image2 is not null)"

QUERIES = {
    "pct_distribution": (pct_distribution, "select o_orderstatus, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (), 4)::double pct from orders group by 1"),
    "event_type_stats": (event_type_stats, "select event_type, count(*) n, round(avg(value), 6) mean, round(count(*) filter (value < 20) / count(*), 6) below, round(quantile_cont(value, 0.5), 6) median from events group by 1"),
    "crop_union_percentiles": (crop_union_percentiles, """select l_returnflag, trunc(quantile_cont(l_quantity::double, 0.05))::int x1, trunc(quantile_cont(l_extendedprice::double, 0.05))::int y1,
        trunc(quantile_cont(l_quantity::double, 0.95))::int x2, trunc(quantile_cont(l_extendedprice::double, 0.95))::int y2 from lineitem group by 1"""),
    "mean_ratios": (mean_ratios, 'select l_linestatus, round(avg(l_discount), 6) as "left", round(avg(l_tax), 6) top, round(avg(l_quantity), 6) as "right", round(avg(l_extendedprice), 6) bottom from lineitem group by 1'),
    "run_summary": (run_summary, "select count(*) total, count(*) filter (o_orderstatus = 'F') success, count(*) filter (o_orderstatus = 'O') skipped, count(*) filter (o_orderstatus = 'P') failed from orders"),
    "cleanup_totals": (cleanup_totals, """with f as (select distinct on (file_id) file_id, source_type, coalesce(strlen(content), 0) n from transcript_files), t as (select source_type, count(*) files, sum(n)::bigint bytes from f group by 1),
        s as (select *, case when bytes < 1024 then 0 when bytes < 1048576 then 1 when bytes < 1073741824 then 2 else 3 end k from t) select source_type, files, bytes, round(bytes / pow(1024.0::double, k), 2) size, ['B', 'KB', 'MB', 'GB'][k + 1] unit from s"""),
    "project_flags": (project_flags, """with u as (select video_id, 'images' k from img union all select video_id, 'entries' from html_data union all select video_id, 'transcript' from transcript_files
        union all select regexp_extract(path1, '^videos/([^/]+)/', 1), 'dedup' from duplicates)
        select video_id, bool_or(k = 'images') has_images, bool_or(k = 'entries') has_entries, bool_or(k = 'dedup') has_dedup, bool_or(k = 'transcript') has_transcript from u where video_id is not null and video_id <> '' group by 1"""),
    "unique_set": (unique_set, f"with {_I}, {_D} select slide_id from i where coalesce(status, '') <> 'blank' and filename not in (select filename from dd)"),
    "item_status": (item_status, f"with {_I}, {_D} select slide_id, case when coalesce(status, '') = 'blank' then 'blank' when filename in (select filename from dd) then 'discard' else 'keep' end item from i"),
    "kept_set_deltas": (kept_set_deltas, """with i as (select distinct slide_id, status from img), o as (select slide_id from i where status = 'unique'), n as (select slide_id from i where slide_id % 3 <> 0)
        select 'old' part, count(*) n from (select * from o except select * from n) union all select 'new', count(*) from (select * from n except select * from o) union all select 'both', count(*) from (select * from o intersect select * from n)"""),
    "resume_anti_join": (resume_anti_join, "select distinct stem from transcript_files where stem not in (select provenance.source_file from knowledge_units where provenance.source_file is not null)"),
    "keep_semi_join": (keep_semi_join, "select distinct entry_id from html_data where video_id in (select video_id from img where status = 'unique')"),
    "multi_source_union_collisions": (multi_source_union_collisions, """with u as (select lower(n_name) as name, 'nation' src from nation union select lower(r_name), 'region' from region union select lower(c_mktsegment), 'customer' from customer
        union select lower(event_type), 'events' from events union select lower(video_id), 'img' from img union select lower(video_id), 'html' from html_data)
        select name, count(*) n, string_agg(src, ',' order by src) sources from u where name is not null group by 1 having count(*) > 1"""),
    "group_flatten_first_image_text": (group_flatten_first_image_text, f"""with i as (select distinct slide_id, video_id, status, {_ST} t from img), k as (select *, floor(t / 300)::bigint b from i where t is not null and coalesce(status, '') <> 'blank'),
        r as (select *, row_number() over (partition by video_id, b order by t, slide_id) rn from k) select slide_id, case when rn = 1 then video_id || '#' || b else '' end as "text" from r"""),
    "duplicate_components": (duplicate_components, """with recursive l as (select lower(trim(image1)) a, lower(trim(image2)) b from duplicates where is_duplicate and image1 is not null and image2 is not null),
        e as (select a, b from l where a <> b and a <> '' and b <> '' union select b, a from l where a <> b and a <> '' and b <> ''),
        r as (select a node, a reach from e union select r.node, e.b from r join e on e.a = r.reach),
        g as (select node, min(reach) keep from r group by 1) select keep, count(*) - 1 flagged from g group by 1"""),
    "fuzzy_best_match": (fuzzy_best_match, None),
    "levenshtein_matches": (levenshtein_matches, """with s as (select distinct section from html_data where section is not null), j as (select section, label, levenshtein(section, label)::int dist from s, vocabulary)
        select section, arg_min(label, (dist, label)) label, min(dist) dist from j group by 1"""),
    "size_reduction": (size_reduction, "select l_linestatus, round((1 - sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)) * 100, 4) pct from lineitem group by 1"),
    "local_supplier_volume": (local_supplier_volume, """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by 1"""),
}
