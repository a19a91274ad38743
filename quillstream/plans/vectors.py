"""Queries over ``embeddings`` (vectors, and hashes made of them) and the image pairs of ``duplicates``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import rules
from quillstream.operators import vectors as vx
from quillstream.operators.graph import star_components
from quillstream.session import Scratch
from quillstream.sources.tables import table

DIMS = 64


def _hashed(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", vx.dhash(F.col("embedding"), DIMS).alias("h"))


def _queries(spark, d):
    """Every row whose id is divisible by 100."""
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def cosine_topk(spark, d):
    """Of each query, the eight nearest rows."""
    return vx.topk_each(table(spark, d, "embeddings"), "embedding", _queries(spark, d), 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def prefiltered_cosine_topk(spark, d):
    where = [F.col("label").isin(1, 3, 5), F.col("vec_id") % 2 == 1]
    return vx.topk_each(table(spark, d, "embeddings"), "embedding", _queries(spark, d), 8, where).select("query_id", "vec_id", "label", F.round("distance", 6).alias("distance"), "rank")


def topk_per_trigger_union(spark, d):
    """Of each query, the top 3 of every label's own ranking, united."""
    return vx.topk_each(table(spark, d, "embeddings"), "embedding", _queries(spark, d), 3, within="label").select("query_id", "label", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def dhash_values(spark, d):
    return _hashed(spark, d).select("vec_id", "h")


def dhash_hamming_pairs(spark, d):
    return vx.hamming_pairs(_hashed(spark, d), "vec_id", "h", 14).select("a", "b", F.col("distance").cast("int").alias("distance"), F.round(1 - F.col("distance") / 64, 6).alias("similarity"))


def ignore_list_anti_join(spark, d):
    """Frames near none of the reference frames."""
    rows = _hashed(spark, d)
    hit = vx.near_references(rows.filter("vec_id >= 20"), rows.filter("vec_id < 20"), "vec_id", "h", 15)
    return rows.filter("vec_id >= 20").select("vec_id").join(hit, "vec_id", "left_anti")


def _against_all(spark, d):
    """Every other row beside each query."""
    return vx.beside(_hashed(spark, d), _queries(spark, d)).filter("vec_id <> query_id")


def one_against_all(spark, d):
    """Each query against all other rows, by vectors and by hashes."""
    e = _against_all(spark, d)
    return e.select("query_id", "vec_id", F.round(vx.cosine(F.col("embedding"), F.col("query")), 6).alias("cos"), vx.hamming(F.col("h"), vx.dhash(F.col("query"), DIMS)).cast("int").alias("distance"))


def connected_duplicate_groups(spark, d):
    """Groups of frames linked by near hashes and near vectors, with the earliest frame as primary."""
    pairs = vx.hamming_pairs(_hashed(spark, d), "vec_id", "h", 14, extra=["embedding"])
    near = pairs.filter(vx.cosine(F.col("a_embedding"), F.col("b_embedding")) > 0.3).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = star_components(near, Scratch(spark, "groups"))
    return labels.groupBy(F.col("label").alias("primary")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node")).alias("a")).select(
        "primary", "n", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("members"))


def histogram_correlation(spark, d):
    """Pearson correlation of each query with all other rows."""
    return _against_all(spark, d).select("query_id", "vec_id", F.round(vx.correlation(F.col("embedding"), F.col("query")), 6).alias("corr"))


def cell_match_ratio(spark, d):
    """Share of grid cells (elements) in which a row is near a query."""
    near = F.zip_with("embedding", "query", lambda x, y: F.abs(x.cast("double") - y.cast("double")) < 0.05)
    return _against_all(spark, d).select("query_id", "vec_id", F.round(F.size(F.filter(near, lambda x: x)) / DIMS, 6).alias("ratio"))


def vector_metrics(spark, d):
    """Population variance, deviation, mean, and entropy over 16 bins, of each vector's elements."""
    e = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    m = e.groupBy("vec_id").agg(F.round(F.var_pop("x"), 6).alias("variance"), F.round(F.stddev_pop("x"), 6).alias("std_dev"), F.round(F.avg("x"), 6).alias("mean"))
    bins = e.groupBy("vec_id", F.floor(F.col("x") * 16).alias("bin")).agg((F.count("*") / DIMS).alias("p"))
    ent = bins.groupBy("vec_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.count("*").alias("bins"), F.round(F.max("p") * 100, 6).alias("dominant_pct"))
    return m.join(ent, "vec_id")


def blank_rule(spark, d):
    """The seven signs of a blank frame over metrics of vectors scaled to grey levels, and the content score."""
    e = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("g", F.floor((F.col("x").cast("double") + 0.5) * 255))
    m = e.groupBy("vec_id").agg(F.round(F.var_pop("g"), 4).alias("var"), F.round(F.stddev_pop("g"), 4).alias("std"), F.round(F.avg("g"), 4).alias("mean"), F.countDistinct("g").alias("used"))
    b = e.groupBy("vec_id", F.floor(F.col("g") / 8).alias("b")).agg((F.count("*") / DIMS).alias("p")).groupBy("vec_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("ent"), F.round(F.max("p") * 100, 4).alias("dom"))
    j = m.join(b, "vec_id").withColumn("div", F.round(F.col("used") / 96, 4))
    r = rules.blank_frame({"variance": F.col("var"), "std": F.col("std"), "mean": F.col("mean"), "entropy": F.col("ent"), "dominant": F.col("dom"), "diversity": F.col("div")})
    return j.withColumn("r", r).select("vec_id", "r.blank_score", "r.is_blank", F.round("r.content_score", 2).alias("content_score"))


def _pairs(spark, d):
    vals = F.map_values("distances")
    p = table(spark, d, "duplicates").filter("image1 is not null and image2 is not null")
    return p.withColumn("min_d", F.array_min(vals)).withColumn("avg_d", F.aggregate(vals, F.lit(0.0), lambda s, x: s + x) / F.size(vals))


def duplicate_decisions(spark, d):
    """The decision made anew from distances, histogram and entropy, under all three presets at once."""
    p = _pairs(spark, d).withColumn("preset", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("t")) for n, t in (("lenient", 15), ("moderate", 12), ("strict", 8))])))
    p = p.withColumn("r", vx.duplicate_decision(F.col("min_d"), F.col("avg_d"), F.col("histogram_similarity"), F.col("entropy"), F.col("preset.t")))
    return p.groupBy(F.col("preset.name").alias("preset"), F.col("r.is_duplicate").alias("is_duplicate"), F.col("r.reason").alias("reason"), F.col("r.adjusted_threshold").alias("adjusted")).agg(F.count("*").alias("n"))


def tiered_decisions(spark, d):
    p = _pairs(spark, d)
    tier = F.when((F.col("min_d") <= 2) & (F.col("histogram_similarity") >= 0.98), "discard").when((F.col("min_d") <= 8) | (F.col("histogram_similarity") >= 0.85), "ambiguous").otherwise("unique")
    return p.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("histogram_similarity"), 6).alias("avg_hist"))


_COS = "list_dot_product({a}::double[], {b}::double[]) / nullif(sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])), 0)"
_LESS = "list_transform({v}::double[], lambda x: x - list_avg({v}::double[]))"
CORR_SQL = "list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0)".format(_LESS.format(v="{a}"), _LESS.format(v="{b}"))
_Q = "q as (select vec_id query_id, embedding q from embeddings where vec_id % 100 = 0)"
_EACH = f"""with {_Q}, e as (select query_id, vec_id, label, 1 - {_COS.format(a='embedding', b='q')} d from embeddings, q),
    r as (select *, row_number() over (partition by query_id{{within}} order by d, vec_id)::int as "rank" from e where d is not null{{where}}) select query_id, vec_id, {{label}}round(d, 6) distance, "rank" from r where "rank" <= {{k}}"""
_DH = "list_sum([case when embedding[i + 2] > embedding[i + 1] then 1::bigint << i else 0::bigint end for i in range(63)])::bigint"
_HE = f"he as (select *, {_DH} h from embeddings)"
_CMP = """select *, list_min(map_values(distances)) mn, list_sum(map_values(distances))::double / len(map_values(distances)) av from duplicates where image1 is not null and image2 is not null"""

QUERIES = {
    "cosine_topk": (cosine_topk, _EACH.format(where="", label="", within="", k=8)),
    "prefiltered_cosine_topk": (prefiltered_cosine_topk, _EACH.format(where=" and label in (1, 3, 5) and vec_id % 2 = 1", label="label, ", within="", k=8)),
    "topk_per_trigger_union": (topk_per_trigger_union, _EACH.format(where="", label="label, ", within=", label", k=3)),
    "dhash_values": (dhash_values, f"with {_HE} select vec_id, h from he"),
    "dhash_hamming_pairs": (dhash_hamming_pairs, f"with {_HE} select a.vec_id a, b.vec_id b, bit_count(xor(a.h, b.h))::int distance, round(1 - bit_count(xor(a.h, b.h)) / 64, 6) similarity from he a join he b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 14"),
    "ignore_list_anti_join": (ignore_list_anti_join, f"with {_HE} select vec_id from he a where vec_id >= 20 and not exists (select 1 from he b where b.vec_id < 20 and bit_count(xor(a.h, b.h)) <= 15)"),
    "one_against_all": (one_against_all, f"with {_HE}, z as (select vec_id query_id, embedding q, h hq from he where vec_id % 100 = 0) select query_id, vec_id, round({_COS.format(a='embedding', b='q')}, 6) cos, bit_count(xor(h, hq))::int distance from he, z where vec_id <> query_id"),
    "connected_duplicate_groups": (connected_duplicate_groups, f"""with recursive {_HE}, e as (select a.vec_id u, b.vec_id v from he a join he b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 14 where {_COS.format(a='a.embedding', b='b.embedding')} > 0.3),
        s as (select u, v from e union select v, u from e), r as (select u node, u reach from s union select r.node, s.v from r join s on s.u = r.reach),
        l as (select node, min(reach) as "primary" from r group by 1) select "primary", count(*) n, string_agg(node::varchar, ',' order by node) members from l group by 1"""),
    "histogram_correlation": (histogram_correlation, f"with {_Q} select query_id, vec_id, round({CORR_SQL.format(a='embedding', b='q')}, 6) corr from embeddings, q where vec_id <> query_id"),
    "cell_match_ratio": (cell_match_ratio, f"""with {_Q}, e as (select query_id, vec_id, unnest(embedding)::double x, unnest(q)::double y from embeddings, q where vec_id <> query_id)
        select query_id, vec_id, round(avg((abs(x - y) < 0.05)::int), 6) ratio from e group by 1, 2"""),
    "vector_metrics": (vector_metrics, """with e as (select vec_id, unnest(embedding)::double x from embeddings), b as (select vec_id, floor(x * 16) bin, count(*) / 64.0::double p from e group by 1, 2),
        n as (select vec_id, round(-sum(p * log2(p)), 6) entropy, count(*) bins, round(max(p) * 100, 6) dominant_pct from b group by 1),
        m as (select vec_id, round(var_pop(x), 6) variance, round(stddev_pop(x), 6) std_dev, round(avg(x), 6) mean from e group by 1) select * from m join n using (vec_id)"""),
    "blank_rule": (blank_rule, """with e as (select vec_id, floor((unnest(embedding)::double + 0.5) * 255) g from embeddings),
        m as (select vec_id, round(var_pop(g), 4) var, round(stddev_pop(g), 4) std, round(avg(g), 4) mean, count(distinct g) used from e group by 1),
        b0 as (select vec_id, floor(g / 8) b, count(*) / 64.0::double p from e group by 1, 2), b as (select vec_id, round(-sum(p * log2(p)), 4) ent, round(max(p) * 100, 4) dom from b0 group by 1),
        j as (select *, round(used / 96, 4) div from m join b using (vec_id)),
        k as (select *, ((var < 500)::int + (std < 15)::int + (ent < 3)::int * 2 + (dom > 85)::int + (mean > 235 or mean < 30)::int + (div < 0.3)::int + (dom < 10 and div > 0.9)::int * 3)::int blank_score,
          (var > 2000 and std > 35 or var > 5000) and not (dom < 10 and div > 0.9) rich, least(25.0, var / 100) + least(25.0, std * 5) + least(25.0, ent * 3) + div * 25 content from j)
        select vec_id, blank_score, ent < 3 or blank_score >= 2 and not rich is_blank, round(case when ent < 3 or blank_score >= 2 and not rich then greatest(0, content - 50) else content end, 2) content_score from k"""),
    "duplicate_decisions": (duplicate_decisions, f"""with p as ({_CMP}), c as (select *, unnest([{{'n': 'lenient', 't': 15}}, {{'n': 'moderate', 't': 12}}, {{'n': 'strict', 't': 8}}]) pr from p),
        a as (select *, pr.n preset, case when entropy < 4 then greatest(pr.t - 3, 5) when entropy > 7 then pr.t + 3 else pr.t end adjusted, histogram_similarity hs from c),
        m as (select *, coalesce(mn <= adjusted and not coalesce(av > adjusted and coalesce(hs, 0) < 0.85, false), false) x, coalesce(hs >= 0.9, false) y, coalesce(av <= adjusted + 3 and hs >= 0.9::double - 0.05::double, false) z from a)
        select preset, x or y or z is_duplicate, case when x or y or z then array_to_string(list_filter([case when x then 'Hash' end, case when y then 'Hist' end, case when z then 'AvgHash' end], lambda q: q is not null), '+') else 'None' end reason,
        adjusted::int adjusted, count(*) n from m group by 1, 2, 3, 4"""),
    "tiered_decisions": (tiered_decisions, f"""with p as ({_CMP}) select case when mn <= 2 and histogram_similarity >= 0.98 then 'discard' when mn <= 8 or histogram_similarity >= 0.85 then 'ambiguous' else 'unique' end tier,
        count(*) n, round(avg(histogram_similarity), 6) avg_hist from p group by 1"""),
}
