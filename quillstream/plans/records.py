"""Queries over ``knowledge_units`` and ``vocabulary``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions.text import concept_stub
from quillstream.operators import records as rc
from quillstream.operators import vocabulary as vc
from quillstream.operators.folds import budget_prefix
from quillstream.schemas import KNOWLEDGE_TYPES
from quillstream.sources.tables import table


def _units(spark, d):
    return rc.distinct_units(table(spark, d, "knowledge_units"))


def flatten_units(spark, d):
    return rc.flatten_units(_units(spark, d))


def retrieval_text(spark, d):
    return _units(spark, d).select("unit_id", rc.retrieval_text(False).alias("table_text"), rc.retrieval_text(True).alias("model_text"))


def payload_invariant(spark, d):
    return _units(spark, d).select("unit_id", F.array_join(rc.violations(), ",").alias("violations"), F.array_join(rc.filled_payloads(), ",").alias("payloads"))


def enum_sanitise(spark, d):
    s = rc.sanitised(_units(spark, d))
    return s.select("unit_id", F.array_join("sessions", ",").alias("sessions"), F.array_join("instruments", ",").alias("instruments"))


def unit_ids_sha1(spark, d):
    u = _units(spark, d).select("unit_id", F.regexp_extract("unit_id", r"^(.*)__(\d+)_(\d+)_[0-9a-f]+$", 1).alias("stem"), F.regexp_extract("unit_id", r"^(.*)__(\d+)_(\d+)_[0-9a-f]+$", 2).cast("int").alias("c"),
                                F.regexp_extract("unit_id", r"^(.*)__(\d+)_(\d+)_[0-9a-f]+$", 3).cast("int").alias("o"))
    return u.select("unit_id", rc.unit_id(F.col("stem"), F.col("c"), F.col("o")).alias("made"))


def search_prefilter(spark, d):
    where = rc.prefilter(knowledge_type="setup", session="ny_am", min_confidence=0.5)
    return _units(spark, d).filter(where).select("unit_id", F.round("metadata.extraction_confidence", 6).alias("confidence"))


def confidence_gate(spark, d, least=0.35):
    kept = F.coalesce(F.col("metadata.extraction_confidence"), F.lit(0.0)) >= least
    return _units(spark, d).groupBy(F.col("provenance.source_type").alias("source_type"), kept.alias("kept")).agg(F.count("*").alias("n"))


def route_by_type(spark, d):
    """Units routed to extraction in batches of 12 per type; skipped are anecdotes and what cannot be tested."""
    kind = F.col("metadata.knowledge_type")
    skip = F.coalesce((kind == "anecdote") | (F.col("metadata.testability") == "not_testable"), F.lit(True))
    routed = _units(spark, d).filter(~skip).select("unit_id", kind.alias("kind"))
    return rc.batches(routed, "kind", ["unit_id"], 12)


def batch_idx_merge(spark, d):
    """Answers by index, some twice and some missing, merged to what was asked."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 7).cast("int").alias("idx"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("answer"))
    asked = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("idx"))
    return rc.merge_batch(asked, e, ["user_id"], "idx", "event_id", "answer")


def json_lenient_parse(spark, d):
    e = table(spark, d, "events")
    fence = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("<think>a {b}</think>\n```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_id") % 4 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.lit("no json"))
    return e.select("event_id", F.get_json_object(rc.json_object(fence), "$.k").try_cast("int").alias("k"))


def canonicalise_concepts(spark, d):
    c = vc.canonicalise(_units(spark, d), table(spark, d, "vocabulary"))
    return c.select("unit_id", F.array_join(F.array_sort("concepts"), ",").alias("concepts"))


def concept_frequency(spark, d):
    return vc.concept_counts(_units(spark, d))


def unmapped_report(spark, d):
    return vc.unmapped(_units(spark, d), table(spark, d, "vocabulary"))


def unmapped_stubs(spark, d):
    return vc.unmapped(_units(spark, d), table(spark, d, "vocabulary")).select("concept", concept_stub("concept").alias("stub"))


def recanonicalise_diff(spark, d):
    u = _units(spark, d)
    ch = vc.changes(u.select("unit_id", F.col("metadata.concepts_canonical").alias("concepts")), vc.canonicalise(u, table(spark, d, "vocabulary")))
    return ch.select("unit_id", F.array_join(F.array_sort(F.array_distinct("gained")), ",").alias("gained"), F.array_join(F.array_sort(F.array_distinct("lost")), ",").alias("lost"))


def recanonicalise_summary(spark, d):
    u = _units(spark, d)
    ch = vc.changes(u.select("unit_id", F.col("metadata.concepts_canonical").alias("concepts")), vc.canonicalise(u, table(spark, d, "vocabulary")))
    return ch.agg(F.count("*").alias("units"), F.count_if(F.size("gained") > 0).alias("with_gain"), F.count_if(F.size("lost") > 0).alias("with_loss"), F.count_if(F.size("gained") >= 2).alias("big_gain"))


def gained_concepts(spark, d):
    u = _units(spark, d)
    ch = vc.changes(u.select("unit_id", F.col("metadata.concepts_canonical").alias("concepts")), vc.canonicalise(u, table(spark, d, "vocabulary")))
    return ch.select(F.explode(F.array_distinct("gained")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n"))


def concept_membership_by_type(spark, d):
    u = _units(spark, d).filter(F.array_contains("metadata.concepts_canonical", "sweep_pylon"))
    return u.groupBy(F.col("metadata.knowledge_type").alias("kind")).agg(F.count("*").alias("n"))


def value_counts_top10(spark, d):
    c = _units(spark, d).groupBy(F.col("provenance.source_file").alias("source_file")).agg(F.count("*").alias("n"))
    return vc.top(c, "n", 10, "source_file")


def type_distribution(spark, d):
    return vc.with_share(_units(spark, d).groupBy(F.col("metadata.knowledge_type").alias("kind")).agg(F.count("*").alias("n")))


def session_counts(spark, d):
    return _units(spark, d).select(F.explode("metadata.session_applicability").alias("session")).groupBy("session").agg(F.count("*").alias("n"))


CONFIDENCE_BINS = [(0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.01)]


def confidence_bins(spark, d):
    """A histogram over fixed bins; empty bins are there with 0."""
    c = F.coalesce(F.col("metadata.extraction_confidence"), F.lit(0.0))
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CONFIDENCE_BINS)], "bin int, low double, high double")
    which = F.coalesce(*[F.when((c >= a) & (c < b), F.lit(i)) for i, (a, b) in enumerate(CONFIDENCE_BINS)])
    n = _units(spark, d).groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(n, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def two_dim_stats_share_below(spark, d):
    c = F.col("metadata.extraction_confidence")
    return _units(spark, d).groupBy(F.col("metadata.knowledge_type").alias("kind"), F.col("provenance.source_type").alias("source")).agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.count_if(c < 0.6) * 1.0 / F.count("*"), 6).alias("below"))


def conditional_counts_by_source(spark, d):
    m = F.col("metadata.concepts_raw")
    return _units(spark, d).groupBy(F.col("provenance.source_type").alias("source")).agg(
        F.count_if(F.col("verbatim_anchor").isNotNull()).alias("with_anchor"), F.count_if(F.coalesce(F.size(m), F.lit(0)) > 0).alias("with_concepts"),
        F.round(F.avg(F.coalesce(F.size(m), F.lit(0))), 6).alias("avg_concepts"), F.count_if(F.col("setup.sequence").isNotNull()).alias("with_sequence"))


def mapping_and_naming_rates(spark, d):
    m = "metadata."
    return _units(spark, d).groupBy(F.col(m + "testability").alias("variant")).agg(
        F.count("*").alias("units"), F.sum(F.coalesce(F.size(m + "concepts_canonical"), F.lit(0))).alias("canon"), F.sum(F.coalesce(F.size(m + "concepts_raw"), F.lit(0))).alias("raw"),
        F.count_if(F.col("setup").isNotNull()).alias("setups"), F.count_if(F.col("setup.name").isNotNull()).alias("named"))


def agreement_matrix(spark, d):
    """Two runs over the same units, odd and even chunks of a file, compared field by field, null-safe."""
    u = _units(spark, d).select(F.col("provenance.source_file").alias("stem"), F.regexp_extract("unit_id", r"_(\d+)_[0-9a-f]+$", 1).cast("int").alias("o"), F.col("metadata.knowledge_type").alias("kind"),
                                F.lower(F.trim("provenance.speaker")).alias("speaker"), F.col("metadata.testability").alias("testability"))
    a, b = u.filter("o % 2 = 1").alias("a"), u.filter("o % 2 = 0").withColumn("o", F.col("o") - 1).alias("b")
    same = lambda c: F.count_if(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"same_{c}")
    return a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a.o") == F.col("b.o"))).agg(F.count("*").alias("common"), same("kind"), same("speaker"), same("testability"))


def map_lookup_default(spark, d):
    """Credibility from a lookup, with a default for what it lacks."""
    known = F.create_map(*[F.lit(x) for kv in (("transcript", "trusted"), ("pdf", "vendor"), ("blog", "community")) for x in kv])
    return _units(spark, d).groupBy(F.coalesce(F.try_element_at(known, F.col("provenance.source_type")), F.lit("unrated")).alias("credibility")).agg(F.count("*").alias("n"))


def context_budget_prefix(spark, d):
    """The most confident units of each type, as many as fit 2,000 characters."""
    u = _units(spark, d).select("unit_id", F.col("metadata.knowledge_type").alias("kind"), (-F.coalesce(F.col("metadata.extraction_confidence"), F.lit(0.0))).alias("rank"), F.least(F.length("summary"), F.lit(500)).alias("size"))
    return budget_prefix(u, "kind", ["rank", "unit_id"], "size", 2000).select("unit_id", "kind", F.col("used").cast("long").alias("used"))


def numbered_context(spark, d):
    """Search results as one numbered block per type."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy("rank", "unit_id")
    u = _units(spark, d).select("unit_id", F.col("metadata.knowledge_type").alias("kind"), (-F.coalesce(F.col("metadata.extraction_confidence"), F.lit(0.0))).alias("rank"), F.left("summary", F.lit(150)).alias("s"))
    u = u.withColumn("i", F.row_number().over(w)).filter("i <= 5").withColumn("line", F.concat(F.lit("[Source "), F.col("i").cast("string"), F.lit("] "), "s"))
    return u.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n---\n").alias("context"))


def notes_by_type(spark, d):
    """Markdown notes of each file, a line for each unit, in the order of ids."""
    line = F.concat(F.lit("- **"), "summary", F.lit("**  \n  _"), F.array_join(F.coalesce("metadata.concepts_canonical", F.array().cast("array<string>")), ", "), F.lit("_"))
    u = _units(spark, d).select("unit_id", F.col("provenance.source_file").alias("file"), line.alias("line"))
    return u.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "line"))), lambda x: x["line"]), "\n").alias("notes"))




_U = "u as (select distinct on (unit_id) * from knowledge_units where unit_id is not null)"
_LEAD = "case when setup is not null then setup.name when contextual is not null then contextual.event_or_condition when framework is not null then framework.method_name when tip is not null then tip.heuristic when psychology is not null then psychology.principle when anecdote is not null then anecdote.embedded_heuristic end"
_PAY = "list_filter([" + ", ".join(f"case when {p} is not null then '{p}' end" for p in KNOWLEDGE_TYPES) + "], lambda x: x is not null)"
_IDX = "idx as (select distinct lower(a) alias, cid from (select cid, unnest(list_concat([label], coalesce(aliases, []))) a from vocabulary) where a <> '')"
_CANON = f"{_U}, {_IDX}, raw as (select unit_id, unnest(metadata.concepts_raw) phrase from u), hit as (select distinct unit_id, cid from raw join idx on contains(lower(phrase), alias))"
_CHG = _CANON + """, n as (select u.unit_id, coalesce(metadata.concepts_canonical, []) old, coalesce(list(cid) filter (cid is not null), []) new from u left join hit using (unit_id) group by all),
  ch as (select unit_id, list_sort(list_distinct(list_filter(new, lambda x: not list_contains(old, x)))) gained, list_sort(list_distinct(list_filter(old, lambda x: not list_contains(new, x)))) lost from n)"""
_COUNTS = """cc as (select lower(trim(c)) concept, f, k from (select unnest(metadata.concepts_raw) c, provenance.source_file f, metadata.knowledge_type k from u) where lower(trim(c)) <> ''),
  cn as (select concept, count(*) n, count(distinct f) files, count(*) filter (k = 'setup') setups from cc group by 1)"""
_UNM = f"with {_U}, {_IDX}, {_COUNTS}, un as (select concept, n from cn where n >= 2 and not exists (select 1 from idx where contains(concept, alias)))"

QUERIES = {
    "flatten_units": (flatten_units, f"""with {_U} select unit_id, summary, coalesce(verbatim_anchor, '') verbatim_anchor, metadata.knowledge_type knowledge_type, metadata.testability testability, coalesce(metadata.extraction_confidence, 0) confidence,
        array_to_string(metadata.session_applicability, ',') sessions, array_to_string(metadata.instrument_applicability, ',') instruments, array_to_string(metadata.concepts_canonical, ',') concepts, array_to_string(metadata.domains, ',') domains,
        provenance.source_file source_file, provenance.source_type source_type, coalesce(provenance.session_date::varchar, '') session_date, coalesce(provenance.speaker, '') speaker, provenance.chunk_id chunk_id, coalesce(provenance.timestamp_range, '') timestamp_range from u"""),
    "retrieval_text": (retrieval_text, f"""with {_U}, l as (select unit_id, summary, {_LEAD} lead, nullif(array_to_string(metadata.concepts_canonical, ', '), '') c,
        nullif(array_to_string(case when len(coalesce(metadata.concepts_canonical, [])) > 0 then metadata.concepts_canonical else metadata.concepts_raw end, ', '), '') cr from u)
        select unit_id, concat_ws(chr(10), summary, c, lead) table_text, concat_ws(chr(10), summary, cr, lead) model_text from l"""),
    "payload_invariant": (payload_invariant, f"""with {_U}, p as (select *, {_PAY} pl from u) select unit_id, array_to_string(pl, ',') payloads, array_to_string(list_filter([case when len(pl) <> 1 then 'payload_count' end,
        case when len(pl) = 1 and pl[1] is distinct from metadata.knowledge_type then 'payload_type' end, case when metadata.extraction_confidence not between 0 and 1 then 'confidence_bounds' end,
        case when coalesce(summary, '') = '' then 'summary_missing' end, case when not coalesce(metadata.knowledge_type in {tuple(KNOWLEDGE_TYPES)}, false) then 'unknown_type' end], lambda x: x is not null), ',') violations from p"""),
    "enum_sanitise": (enum_sanitise, f"""with {_U} select unit_id, coalesce(nullif(array_to_string(list_filter(metadata.session_applicability, lambda x, i: x in ('asia_tokyo', 'london', 'ny_am', 'ny_pm', 'overnight', 'any') and list_position(metadata.session_applicability, x) = i), ','), ''), 'any') sessions,
        coalesce(nullif(array_to_string(list_filter(metadata.instrument_applicability, lambda x, i: x in ('NQ', 'ES', 'YM', 'RTY', 'CL', 'GC', 'any') and list_position(metadata.instrument_applicability, x) = i), ','), ''), 'any') instruments from u"""),
    "unit_ids_sha1": (unit_ids_sha1, rf"""with {_U}, s as (select unit_id, regexp_extract(unit_id, '^(.*)__(\d+)_(\d+)_[0-9a-f]+$', 1) stem, regexp_extract(unit_id, '^(.*)__(\d+)_(\d+)_[0-9a-f]+$', 2)::int c, regexp_extract(unit_id, '^(.*)__(\d+)_(\d+)_[0-9a-f]+$', 3)::int o from u)
        select unit_id, stem || '__' || printf('%02d_%02d_', c, o) || left(sha1(stem || ':' || c || ':' || o), 10) made from s"""),
    "search_prefilter": (search_prefilter, f"with {_U} select unit_id, round(metadata.extraction_confidence, 6) confidence from u where metadata.knowledge_type = 'setup' and (list_contains(metadata.session_applicability, 'ny_am') or list_contains(metadata.session_applicability, 'any')) and metadata.extraction_confidence >= 0.5"),
    "confidence_gate": (confidence_gate, f"with {_U} select provenance.source_type source_type, coalesce(metadata.extraction_confidence, 0) >= 0.35 kept, count(*) n from u group by 1, 2"),
    "route_by_type": (route_by_type, f"""with {_U}, r as (select unit_id, metadata.knowledge_type kind from u where not coalesce(metadata.knowledge_type = 'anecdote' or metadata.testability = 'not_testable', true)),
        k as (select *, row_number() over (partition by kind order by unit_id) - 1 n from r) select unit_id, kind, (n // 12)::int batch, (n % 12)::int in_batch from k"""),
    "batch_idx_merge": (batch_idx_merge, """with a as (select distinct user_id, unnest(range(7))::int idx from events), r as (select user_id, (event_id % 7)::int idx, arg_max('a' || event_id, event_id) answer from events group by 1, 2)
        select a.user_id, a.idx, answer from a left join r on r.user_id = a.user_id and r.idx = a.idx"""),
    "json_lenient_parse": (json_lenient_parse, "select event_id, case when event_id % 4 < 3 then (props::json ->> 'k')::int end k from events"),
    "canonicalise_concepts": (canonicalise_concepts, f"with {_CANON} select u.unit_id, coalesce(string_agg(cid, ',' order by cid), '') concepts from u left join hit using (unit_id) group by 1"),
    "concept_frequency": (concept_frequency, f"with {_U}, {_COUNTS} select concept, n, files, setups from cn"),
    "unmapped_report": (unmapped_report, _UNM + " select concept, n from un"),
    "unmapped_stubs": (unmapped_stubs, _UNM + " select concept, case when trim(regexp_replace(concept, '[^a-z0-9]+', '_', 'g'), '_') = '' then 'unnamed_concept' else left(trim(regexp_replace(concept, '[^a-z0-9]+', '_', 'g'), '_'), 40) end stub from un"),
    "recanonicalise_diff": (recanonicalise_diff, f"with {_CHG} select unit_id, array_to_string(gained, ',') gained, array_to_string(lost, ',') lost from ch"),
    "recanonicalise_summary": (recanonicalise_summary, f"with {_CHG} select count(*) units, count(*) filter (len(gained) > 0) with_gain, count(*) filter (len(lost) > 0) with_loss, count(*) filter (len(gained) >= 2) big_gain from ch"),
    "gained_concepts": (gained_concepts, f"with {_CHG} select cid, count(*) n from (select unnest(gained) cid from ch) group by 1"),
    "concept_membership_by_type": (concept_membership_by_type, f"with {_U} select metadata.knowledge_type kind, count(*) n from u where list_contains(metadata.concepts_canonical, 'sweep_pylon') group by 1"),
    "value_counts_top10": (value_counts_top10, f"with {_U} select provenance.source_file source_file, count(*) n from u group by 1 order by n desc, source_file limit 10"),
    "type_distribution": (type_distribution, f"with {_U} select metadata.knowledge_type kind, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (), 4)::double pct from u group by 1"),
    "session_counts": (session_counts, f"with {_U} select session, count(*) n from (select unnest(metadata.session_applicability) session from u) group by 1"),
    "confidence_bins": (confidence_bins, f"""with {_U}, b as (select * from (values (0, 0.0::double, 0.3::double), (1, 0.3, 0.5), (2, 0.5, 0.7), (3, 0.7, 0.9), (4, 0.9, 1.01)) t(bin, low, high))
        select bin, low, high, count(unit_id) n from b left join u on coalesce(metadata.extraction_confidence, 0) >= low and coalesce(metadata.extraction_confidence, 0) < high group by 1, 2, 3"""),
    "two_dim_stats_share_below": (two_dim_stats_share_below, f"""with {_U} select metadata.knowledge_type kind, provenance.source_type source, count(*) n, round(avg(metadata.extraction_confidence), 6) mean,
        round(count(*) filter (metadata.extraction_confidence < 0.6) * 1.0::double / count(*), 6) below from u group by 1, 2"""),
    "conditional_counts_by_source": (conditional_counts_by_source, f"""with {_U} select provenance.source_type source, count(verbatim_anchor) with_anchor, count(*) filter (len(metadata.concepts_raw) > 0) with_concepts,
        round(avg(coalesce(len(metadata.concepts_raw), 0)), 6) avg_concepts, count(setup.sequence) with_sequence from u group by 1"""),
    "mapping_and_naming_rates": (mapping_and_naming_rates, f"""with {_U} select metadata.testability variant, count(*) units, sum(coalesce(len(metadata.concepts_canonical), 0))::bigint canon, sum(coalesce(len(metadata.concepts_raw), 0))::bigint raw,
        count(*) filter (setup is not null) setups, count(setup.name) named from u group by 1"""),
    "agreement_matrix": (agreement_matrix, rf"""with {_U}, x as (select provenance.source_file stem, regexp_extract(unit_id, '_(\d+)_[0-9a-f]+$', 1)::int o, metadata.knowledge_type kind, lower(trim(provenance.speaker)) speaker, metadata.testability testability from u)
        select count(*) common, count(*) filter (a.kind is not distinct from b.kind) same_kind, count(*) filter (a.speaker is not distinct from b.speaker) same_speaker, count(*) filter (a.testability is not distinct from b.testability) same_testability
        from x a join x b on a.stem = b.stem and a.o % 2 = 1 and b.o = a.o + 1"""),
    "map_lookup_default": (map_lookup_default, f"with {_U} select case provenance.source_type when 'transcript' then 'trusted' when 'pdf' then 'vendor' when 'blog' then 'community' else 'unrated' end credibility, count(*) n from u group by 1"),
    "context_budget_prefix": (context_budget_prefix, f"""with {_U}, r as (select unit_id, metadata.knowledge_type kind, sum(least(length(summary), 500)) over (partition by metadata.knowledge_type order by -coalesce(metadata.extraction_confidence, 0), unit_id)::bigint used from u)
        select unit_id, kind, used from r where used <= 2000"""),
    "numbered_context": (numbered_context, f"""with {_U}, r as (select metadata.knowledge_type kind, left(summary, 150) s, row_number() over (partition by metadata.knowledge_type order by -coalesce(metadata.extraction_confidence, 0), unit_id) i from u)
        select kind, string_agg('[Source ' || i || '] ' || s, chr(10) || '---' || chr(10) order by i) context from r where i <= 5 group by 1"""),
    "notes_by_type": (notes_by_type, f"""with {_U} select provenance.source_file file, string_agg('- **' || summary || '**  ' || chr(10) || '  _' || coalesce(array_to_string(metadata.concepts_canonical, ', '), '') || '_', chr(10) order by unit_id) notes from u group by 1"""),
}
