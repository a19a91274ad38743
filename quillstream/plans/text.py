"""Queries over texts: ``transcript_files``, ``html_data``, ``documents``, and names of ``img`` and ``duplicates``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import rules
from quillstream.functions import text as tx
from quillstream.functions.timefns import offset_seconds, two_digits
from quillstream.operators import captions as cp
from quillstream.operators import folds
from quillstream.plans.timeline import OFFSET_SQL
from quillstream.sources import transcripts as tr
from quillstream.sources.tables import table


def _files(spark, d):
    return table(spark, d, "transcript_files").filter("content is not null").dropDuplicates(["file_id"])


def transcript_lines(spark, d):
    return tr.stamped_lines(_files(spark, d), "file_id", "content")


def transcript_sections(spark, d):
    return tr.sectioned_lines(_files(spark, d), "file_id", "content")


def vtt_cues(spark, d):
    return tr.vtt_cues(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


def transcript_line_clean(spark, d):
    s = tr.stamped_lines(_files(spark, d), "file_id", "content")
    one = tx.capitalise(tx.drop_leading_filler(tx.fix_contractions(tx.strip_caption("text"))))
    return s.select("file_id", "line_no", one.alias("text"), tx.is_junk("text").alias("junk"))


def sentence_counts(spark, d):
    s = tx.sentences(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(s).alias("n"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


def repeated_line_dedup(spark, d):
    """Lines of a document once each, case aside, the first kept; under 40 characters left out."""
    ln = tr.lines_of(table(spark, d, "documents").filter("text is not null"), "doc_id", "text").withColumn("line", F.trim("raw")).filter("length(line) >= 40")
    return ln.groupBy("doc_id", F.lower("line").alias("low")).agg(F.min("line_no").alias("line_no")).select("doc_id", "line_no", F.md5("low").alias("line"))


def fixed_char_chunks(spark, d):
    c = table(spark, d, "transcript_files").filter("content is not null").dropDuplicates(["file_id"])
    return c.select("file_id", F.posexplode(folds.fixed_chunks(F.col("content"), 4000)).alias("pos", "chunk")).select("file_id", "pos", F.md5("chunk").alias("h"))


def sampled_sections(spark, d):
    return _files(spark, d).select("file_id", F.md5(folds.sampled_sections(F.col("content"), 20000, 7000)).alias("h"))


def greedy_line_chunks(spark, d):
    lines = F.split("content", "\n")
    return _files(spark, d).select("file_id", F.posexplode(folds.greedy_chunks(lines, 4000)).alias("pos", "chunk")).select("file_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("h"))


def transcripts_cleaned(spark, d):
    return _files(spark, d).select("file_id", cp.clean_transcript(F.col("content")).alias("text"))


def overlaps_trimmed(spark, d):
    return _files(spark, d).select("file_id", cp.trim_overlaps(F.transform(F.split("content", "\n"), lambda x: F.trim(x))).alias("lines"))


def blocks_by_5min(spark, d):
    """Text of stamped lines in groups of five minutes, in order; empty groups between are kept."""
    s = tr.stamped_lines(_files(spark, d), "file_id", "content").withColumn("b", F.floor(F.col("seconds") / 300))
    g = s.groupBy("file_id", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n"))
    span = g.groupBy("file_id").agg(F.explode(F.sequence(F.lit(0).cast("bigint"), F.max("b"))).alias("b"))
    label = F.concat(two_digits(F.col("b") * 5), F.lit(":00 - "), two_digits(F.col("b") * 5 + 5), F.lit(":00"))
    return span.join(g, ["file_id", "b"], "left").select("file_id", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))


def longest_text_per_stamp(spark, d):
    h = table(spark, d, "html_data").filter("video_id is not null").withColumn("s", offset_seconds("timestamp")).filter("s is not null and text is not null")
    best = F.max_by("text", F.struct(F.length("text").alias("n"), (-F.col("entry_id")).alias("e")))
    return h.groupBy("video_id", F.round("s", 3).alias("s")).agg(best.alias("text"))


def entry_offsets(spark, d):
    return table(spark, d, "html_data").select("entry_id", F.round(offset_seconds("timestamp"), 6).alias("s")).distinct()


def high_value_entries(spark, d):
    return table(spark, d, "html_data").select("entry_id", "text").distinct().filter(tx.has_high_value("text")).select("entry_id")


# What is looked for in a text, and the search it stands for.
TRIGGERS = [
    ("FVG", "fair value gap imbalance entry"), ("CSD", "change in state of delivery CSD entry"), ("MSS", "market structure shift MSS"),
    ("order block", "order block entry OB"), ("liquidity sweep", "liquidity sweep buy-side sell-side"), ("Judas", "Judas swing fake move London session"),
    ("Power of Three", "power of three accumulation manipulation distribution"), ("Po3", "power of three accumulation manipulation distribution"),
    ("MMXM", "market maker buy sell model MMXM"), ("Silver Bullet", "silver bullet entry window"), ("OTE", "optimal trade entry OTE"),
    ("killzone", "killzone trading session timing"), ("overnight session", "overnight session ONS profile trading"),
    ("premium", "premium discount dealing range"), ("discount", "premium discount dealing range"), ("PDH", "prior day high low reference level"),
    ("PDL", "prior day high low reference level"), ("midnight open", "midnight open reference level"), ("7 Rule", "Kish 7 Rules execution framework"),
    ("trendline", "trendline entry model"), ("breaker", "breaker block entry"), ("turtle soup", "turtle soup liquidity sweep"),
]


def trigger_detection(spark, d):
    """Triggers within texts, case aside, with the search each stands for."""
    t = F.array(*[F.struct(F.lit(a).alias("trigger"), F.lit(b).alias("query")) for a, b in TRIGGERS])
    docs = table(spark, d, "documents").filter("text is not null").withColumn("low", F.lower("text"))
    return docs.select("doc_id", F.inline(F.filter(t, lambda x: F.contains(F.col("low"), F.lower(x["trigger"])))))


def number_claims(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tx.number_claims("text").alias("n"))


def bold_figures(spark, d):
    return table(spark, d, "html_data").select("entry_id", "text").distinct().filter("text is not null").select("entry_id", tx.bold_figures("text").alias("text"))


def url_names(spark, d):
    u = table(spark, d, "documents").filter("url is not null")
    return u.select("doc_id", tx.slugify("url").alias("slug"), tx.sanitize_filename("url").alias("safe"), tx.match_name("url").alias("name"), tx.is_video_url("url").alias("video"))


def video_ids(spark, d):
    u = table(spark, d, "img").select("video_id").distinct()
    kind = F.ascii(F.right("video_id", F.lit(1))) % 3
    made = F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id", F.lit("&t=3"))).when(kind == 1, F.concat(F.lit("youtu.be/"), "video_id", F.lit("?x=1"))).otherwise(F.concat(F.lit("https://else.example/"), "video_id"))
    return u.select("video_id", tx.video_id(made).alias("found"), tx.is_video_url(made).alias("video"))


def dates_in_names(spark, d):
    return _files(spark, d).select("file_id", F.regexp_extract("stem", r"(\d{4})[-_](\d{2})[-_](\d{2})", 0).try_cast("date").cast("string").alias("date"))


def stems_and_pages(spark, d):
    p = table(spark, d, "duplicates").select("path1").filter("path1 is not null").distinct()
    paged = tx.paged_image(F.when(F.length("path1") % 2 == 0, F.regexp_replace("path1", r"_([0-9]+)_[^/]*$", "_p$1.png")).otherwise(F.col("path1")))
    return p.select("path1", tx.stem("path1").alias("stem"), paged.alias("p")).select("path1", "stem", "p.source", "p.page")


def byte_sizes(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 17).alias("n"))
    return e.select("o_orderkey", tx.byte_size("n").alias("s")).select("o_orderkey", "s.value", "s.unit")


def verbatim_fidelity(spark, d):
    """Share of chunks whose probes are found in their own file, before and after clean up of stamps."""
    pieces = F.transform(folds.fixed_chunks(F.col("content"), 4000), tx.verbatim_form)
    f = _files(spark, d).select("source_type", tx.verbatim_form("content").alias("src"), pieces.alias("p"))
    hits = F.size(F.filter("p", lambda seg: F.exists(tx.probes(seg), lambda x: F.contains(F.col("src"), x))))
    return f.groupBy("source_type").agg(F.sum(F.size("p")).alias("segments"), F.round(F.sum(hits) / F.sum(F.size("p")), 6).alias("fidelity"))


def find_replace_counts(spark, d):
    h = table(spark, d, "html_data").select("entry_id", "text").distinct().filter("text is not null")
    a, b = tx.find_replace("text", "the", "THE"), tx.find_replace("text", "the", "THE", ignore_case=True)
    return h.agg(F.count_if(a != F.col("text")).alias("exact"), F.count_if(b != F.col("text")).alias("any_case"))


def page_triage(spark, d):
    """Documents as pages: class by amount of text and share of short lines."""
    t = table(spark, d, "documents").withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
    img = (F.col("doc_id") % 10) / 10.0
    cls = rules.page_dominance(F.col("chars"), img, F.lit(1))
    return t.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), cls.alias("dominance"))


def triage_rollup(spark, d):
    p = page_triage(spark, d).rollup("source", "dominance").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return p.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), F.coalesce("dominance", F.lit("ALL")).alias("dominance"), "n", "level")


def triage_pivot(spark, d):
    names = ["near_empty", "image_dominant", "text_dominant", "co_dependent"]
    return page_triage(spark, d).groupBy("source").pivot("dominance", names).agg(F.count(F.lit(1))).select("source", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


_NLT = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_F = "f as (select distinct on (file_id) * from transcript_files where content is not null)"
_LN = _F + ", ln as (select file_id, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) raw, generate_subscripts(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) - 1 line_no from f)"
_SEC = lambda x: f"(split_part({x}, ':', 1)::int * 3600 + split_part({x}, ':', 2)::int * 60 + split_part({x}, ':', 3)::int)"
_ST = _LN + r""", st as (select file_id, line_no::int line_no, regexp_extract(raw, '^\[(\d{2}:\d{2}:\d{2})\]\s*(.+)', 1) ts, regexp_extract(raw, '^\[(\d{2}:\d{2}:\d{2})\]\s*(.+)', 2) as "text" from ln where regexp_matches(raw, '^\[(\d{2}:\d{2}:\d{2})\]\s*(.+)'))"""
_TRI = """p as (select doc_id, coalesce(source, 'none') source, coalesce(length(text), 0) c, doc_id % 10 / 10.0::double i from documents), t as (select doc_id, source, case when c < 80 and i < 0.05 then 'near_empty' when i >= 0.85 then 'image_dominant'
  when i < 0.05 then 'text_dominant' when c < 200 and i > 0.3 then 'image_dominant' when c > 1500 and i < 0.15 then 'text_dominant' else 'co_dependent' end dominance from p)"""
_VTT = r"""v as (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) tx from documents where starts_with(text, 'WEBVTT')),
  ln as (select doc_id, unnest(string_split(tx, chr(10))) raw, generate_subscripts(string_split(tx, chr(10)), 1) - 1 line_no from v),
  m as (select *, nullif(regexp_extract(raw, '^(\d{2}:\d{2}:\d{2})\.\d{3} --> (\d{2}:\d{2}:\d{2})\.\d{3}', 1), '') stamp from ln),
  w as (select *, max(case when stamp is not null then line_no end) over (partition by doc_id order by line_no) cue, last_value(stamp ignore nulls) over (partition by doc_id order by line_no) start from m),
  b as (select doc_id, cue, start, line_no, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<\d{2}:\d{2}:\d{2}\.\d{3}>|</?c[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g')) t
    from w where start is not null and stamp is null and not regexp_matches(raw, '^\s*$|^(WEBVTT|Kind:|Language:|NOTE)|align:|position:|^\d+$')),
  c as (select doc_id, cue, start, string_agg(t, ' ' order by line_no) t from b where t <> '' group by 1, 2, 3)"""
_VERB = lambda c: rf"trim(lower(regexp_replace(regexp_replace({c}, '\[[^\]]*\]', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ')"
_TRIG = ", ".join(f"('{a}', '{b}')" for a, b in TRIGGERS)
_H = "h as (select distinct entry_id, text from html_data)"

def _strip_sql(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(trim({c}, ' '), '^\[[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\][ \t\n\x0b\f\r]*', ''), '[ \t\n\x0b\f\r]+', ' ', 'g')"
    for n in tx.NOISE:
        out = f"replace({out}, '{n}', '')"
    return f"trim({out}, ' ')"


def _contractions_sql(c: str) -> str:
    for a, b in tx.CONTRACTIONS:
        c = f"replace({c}, '{a}', '{b}')".replace("n't", "n''t").replace("I'm", "I''m").replace("t's", "t''s")
    return c


_JUNK_SQL = "|".join(f"({p})" for p in tx.JUNK).replace("'", "''")

QUERIES = {
    "transcript_lines": (transcript_lines, f"""with {_ST} select file_id, line_no, {_SEC('ts')} as "seconds", "text" from st"""),
    "transcript_sections": (transcript_sections, rf"""with {_LN}, h as (select *, case when starts_with(raw, '## ') then trim(substr(raw, 4)) end head from ln),
        s as (select *, coalesce(last_value(head ignore nulls) over (partition by file_id order by line_no), 'General') section, regexp_extract(raw, '\[(\d{{2}}:\d{{2}}:\d{{2}})\]', 1) ts from h)
        select file_id, line_no::int line_no, section, {_SEC('ts')} as "seconds", trim(regexp_replace(raw, '\[(\d{{2}}:\d{{2}}:\d{{2}})\]', '', 'g')) as "text" from s where head is null and ts <> ''"""),
    "vtt_cues": (vtt_cues, f"""with {_VTT} select doc_id, {_SEC('start')} as "seconds", arg_max(t, (length(t), -cue)) as "text" from c group by doc_id, start"""),
    "transcript_line_clean": (transcript_line_clean, f"""with {_ST}, a as (select file_id, line_no, "text" tx, {_strip_sql('"text"')} s from st), b as (select *, {_contractions_sql('s')} c from a), c as (select *, regexp_replace(c, '^(?i:(Um|Uh|Ah|Like|So|You know),?[ \\t\\n\\x0b\\f\\r]+)', '') g from b)
        select file_id, line_no, upper(left(g, 1)) || substr(g, 2) as "text", regexp_matches(lower(tx), '{_JUNK_SQL}') junk from c"""),
    "sentence_counts": (sentence_counts, r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') a from documents where text is not null)
        select doc_id, len(a)::int n, coalesce(list_max(list_transform(a, lambda x: length(x))), 0)::int longest from s"""),
    "repeated_line_dedup": (repeated_line_dedup, f"""with ln as (select doc_id, unnest({_NLT}) raw, generate_subscripts({_NLT}, 1) - 1 line_no from documents where text is not null)
        select doc_id, min(line_no)::int line_no, md5(lower(trim(raw, ' '))) line from ln where length(trim(raw, ' ')) >= 40 group by doc_id, lower(trim(raw, ' '))"""),
    "fixed_char_chunks": (fixed_char_chunks, f"with {_F}, p as (select file_id, content, unnest(range(0, greatest(0, ceil(length(content) / 4000)::int))) pos from f) select file_id, pos::int pos, md5(substr(content, pos * 4000 + 1, 4000)) h from p"),
    "sampled_sections": (sampled_sections, f"""with {_F} select file_id, md5(case when length(content) > 20000 then left(content, 7000) || chr(10) || '...' || chr(10) || substr(content, length(content) // 2 - 3500 + 1, 7000) || chr(10) || '...' || chr(10) || right(content, 7000) else content end) h from f"""),
    "greedy_line_chunks": (greedy_line_chunks, None),
    "transcripts_cleaned": (transcripts_cleaned, None),
    "overlaps_trimmed": (overlaps_trimmed, None),
    "blocks_by_5min": (blocks_by_5min, f"""with {_ST}, s as (select *, {_SEC('ts')} // 300 b from st), g as (select file_id, b, string_agg("text", ' ' order by line_no) t, count(*) n from s group by 1, 2),
        x as (select file_id, unnest(range(0, (max(b) + 1)::bigint)) b from g group by 1) select x.file_id, lpad((x.b * 5)::varchar, greatest(2, length((x.b * 5)::varchar))::int, '0') || ':00 - ' || lpad((x.b * 5 + 5)::varchar, greatest(2, length((x.b * 5 + 5)::varchar))::int, '0') || ':00' label, coalesce(n, 0) n, md5(coalesce(t, '')) h from x left join g on g.file_id = x.file_id and g.b = x.b"""),
    "longest_text_per_stamp": (longest_text_per_stamp, f"""with h as (select video_id, entry_id, text, {OFFSET_SQL} s from html_data where video_id is not null and text is not null)
        select video_id, round(s, 3) s, arg_max(text, (length(text), -entry_id)) as "text" from h where s is not null group by 1, round(s, 3)"""),
    "entry_offsets": (entry_offsets, f"select distinct entry_id, round({OFFSET_SQL}, 6) s from html_data"),
    "high_value_entries": (high_value_entries, f"with {_H} select entry_id from h where regexp_matches(text, 'basis points|MAE|MFE|0-5 box|line in the sand|reversal|if.*then|fair value gap|order block', 'i')"),
    "trigger_detection": (trigger_detection, f"select doc_id, t.trigger, t.query from documents join (values {_TRIG}) t(trigger, query) on contains(lower(text), lower(t.trigger))"),
    "number_claims": (number_claims, r"select doc_id, len(regexp_extract_all(text, '(?i)\b[0-9]{3,5}\b|\b[0-9]+\s*(point|pt|pip|%)\b'))::int n from documents where text is not null"),
    "bold_figures": (bold_figures, rf"""with {_H} select entry_id, regexp_replace(regexp_replace(text, '(\d+(?:\.\d+)?%)', '**\1**', 'g'), '(\b\d{{4}}\.\d{{2}}\b)', '**\1**', 'g') as "text" from h where text is not null"""),
    "url_names": (url_names, r"""select doc_id, left(trim(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '_', 'g'), '_'), 80) slug,
        rtrim(left(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g')), 100), '. ') safe,
        trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '([^.])\.[^.\s]*$', '\1'), '[_\-.]', ' ', 'g'), '\s+', ' ', 'g')) as name, false video from documents where url is not null"""),
    "video_ids": (video_ids, "select distinct video_id, case when ascii(right(video_id, 1)) % 3 < 2 then video_id end found, ascii(right(video_id, 1)) % 3 < 2 video from img"),
    "dates_in_names": (dates_in_names, rf"with {_F} select file_id, try_cast(replace(nullif(regexp_extract(stem, '(\d{{4}})[-_](\d{{2}})[-_](\d{{2}})'), ''), '_', '-') as date)::varchar as \"date\" from f".replace('\\"', '"')),
    "stems_and_pages": (stems_and_pages, r"""with p as (select distinct path1, case when length(path1) % 2 = 0 then regexp_replace(path1, '_([0-9]+)_[^/]*$', '_p\1.png') else path1 end q from duplicates where path1 is not null)
        select path1, regexp_extract(path1, '([^/]+?)(\.[^./]*)?$', 1) stem, nullif(regexp_extract(q, '([^/]*)_p([0-9]+)\.png$', 1), '') source, try_cast(nullif(regexp_extract(q, '([^/]*)_p([0-9]+)\.png$', 2), '') as int) page from p"""),
    "byte_sizes": (byte_sizes, """with n as (select o_orderkey, o_orderkey * o_orderkey * 17 n from orders), s as (select *, case when n < 1024 then 0 when n < 1048576 then 1 when n < 1073741824 then 2 when n < 1099511627776 then 3 else 4 end k from n)
        select o_orderkey, round(n / pow(1024.0::double, k), 2) as "value", ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] unit from s"""),
    "verbatim_fidelity": (verbatim_fidelity, rf"""with {_F}, p as (select file_id, source_type, content, unnest(range(0, greatest(0, ceil(length(content) / 4000)::int))) pos from f), s as (select file_id, source_type, {_VERB('content')} src, {_VERB('substr(content, pos * 4000 + 1, 4000)')} seg from p),
        h as (select source_type, case when length(seg) > 90 then contains(src, substr(seg, 11, 40)) or contains(src, substr(seg, length(seg) // 2 + 1, 40)) or contains(src, substr(seg, length(seg) - 49, 40)) else contains(src, seg) end hit from s)
        select source_type, count(*) segments, round(count(*) filter (hit) / count(*), 6) fidelity from h group by 1"""),
    "find_replace_counts": (find_replace_counts, f"with {_H} select count(*) filter (contains(text, 'the')) exact, count(*) filter (regexp_replace(text, 'the', 'THE', 'gi') <> text) any_case from h"),
    "page_triage": (page_triage, f"with {_TRI} select doc_id, source, dominance from t"),
    "triage_rollup": (triage_rollup, f"with {_TRI} select coalesce(source, 'TOTAL') source, coalesce(dominance, 'ALL') dominance, count(*) n, grouping(source, dominance)::int as \"level\" from t group by rollup (source, dominance)".replace('\\"', '"')),
    "triage_pivot": (triage_pivot, f"""with {_TRI} select source, count(*) filter (dominance = 'near_empty') near_empty, count(*) filter (dominance = 'image_dominant') image_dominant,
        count(*) filter (dominance = 'text_dominant') text_dominant, count(*) filter (dominance = 'co_dependent') co_dependent from t group by 1"""),
}
