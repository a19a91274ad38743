"""Queries along time: ``events`` has slides (view), lines (purchase) and headers (signup) of users as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions.timefns import clock_to_seconds, offset_seconds, seconds_to_clock, seconds_to_short_clock, slide_seconds
from quillstream.operators import folds
from quillstream.operators import timeline as tl
from quillstream.sources.tables import table


def _events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("t", F.col("us") / 1_000_000.0)
    return e.filter(F.col("event_type") == kind) if kind else e


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "purchase").withColumn("line_id", F.col("event_id")).withColumn("line_value", F.col("value"))


_T = "(epoch_us(ts) / 1000000.0)"
_SLIDES = f"slides as (select event_id, user_id, {_T} t from events where event_type = 'view'), lines as (select event_id line_id, user_id, {_T} t, value from events where event_type = 'purchase')"


def _interval(spark: SparkSession, d: str, **kw) -> DataFrame:
    joined = tl.interval_join(_events(spark, d, "view"), _lines(spark, d), "user_id", "t", "event_id", ["line_id", "line_value"], **kw)
    return joined.groupBy("user_id", F.col("event_id").alias("slide_id")).agg(
        F.count("line_id").alias("n_lines"), F.round(F.coalesce(F.sum("line_value"), F.lit(0.0)), 4).alias("sum_value"), F.min("line_id").alias("first_line"))


def _interval_sql(start: str = "t", end: str = "nx") -> str:
    return f"""with {_SLIDES}, s0 as (select *, lead(t) over (partition by user_id order by t, event_id) nx, row_number() over (partition by user_id order by t, event_id) rn from slides),
    s as (select user_id, event_id, {start} a, {end} b from s0)
    select s.user_id, s.event_id slide_id, count(l.line_id) n_lines, round(coalesce(sum(l.value), 0), 4) sum_value, min(l.line_id) first_line
    from s left join lines l on l.user_id = s.user_id and l.t >= s.a and (s.b is null or l.t < s.b) group by all"""


def asof_active_slide_tol2s(spark, d):
    return tl.asof_backward(_lines(spark, d).select("user_id", "t", "line_id"), _events(spark, d, "view"), "user_id", "t", "line_id", "event_id", 2.0).select(
        "user_id", "line_id", F.coalesce("event_id", F.lit(-1)).alias("slide_id"))


def asof_first_slide_fallback(spark, d):
    out = tl.asof_with_fallback(_lines(spark, d).select("user_id", "t", "line_id"), _events(spark, d, "view"), "user_id", "t", "line_id", "event_id", 2.0, 86400.0)
    return out.select("user_id", "line_id", F.col("event_id").alias("slide_id"))


def nearest_slide(spark, d):
    return tl.nearest(_lines(spark, d).select("user_id", "t", "line_id"), _events(spark, d, "view"), "user_id", "t", "line_id", "event_id").select(
        "user_id", "line_id", F.col("event_id").alias("slide_id"))


def band_self_join_pairs_600s(spark, d):
    out = tl.band_pairs(_events(spark, d), "user_id", "t", "event_id", 600.0, ["value"], "abs(a_value - b_value) <= 40")
    return out.select("user_id", "a_id", "b_id", F.round("dt", 4).alias("dt"))


def gap_analysis(spark, d):
    g = tl.gaps(_events(spark, d), "user_id", "t", "event_id")
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") < 3600).alias("close_pairs"), F.count_if(F.col("gap") > 86400).alias("large_gaps"), F.round(F.max("gap"), 4).alias("max_gap"))


def tumbling_5min_groups(spark, d):
    return _events(spark, d).groupBy("user_id", F.floor(F.col("t") / 300).alias("bucket")).agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type"))), lambda s: s["event_type"]), " ").alias("text"))


def tumbling_daily_groups_dense(spark, d):
    """Groups without rows between a user's first and last are kept."""
    b = _events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"))
    span = b.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(b, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


def two_sided_buckets(spark, d):
    """Images and lines bucketed each for itself; a bucket exists where either side has rows."""
    img = _events(spark, d, "view").groupBy("user_id", F.floor(F.col("t") / 3600).alias("bucket")).agg(F.count("*").alias("images"))
    lin = _events(spark, d, "purchase").groupBy("user_id", F.floor(F.col("t") / 3600).alias("bucket")).agg(F.count("*").alias("lines"), F.round(F.sum("value"), 4).alias("total"))
    return img.join(lin, ["user_id", "bucket"], "full").select("user_id", "bucket", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("lines", F.lit(0)).alias("lines"), "total")


def _headed(spark, d):
    e = _events(spark, d)
    return e.withColumn("header", F.when(F.col("event_type") == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string"))))


def section_forward_fill(spark, d):
    out = tl.forward_fill(_headed(spark, d), "user_id", ["us", "event_id"], "header", "section", "General")
    return out.filter("event_type <> 'signup'").select("event_id", "section")


def section_changes(spark, d):
    out = tl.forward_fill(_headed(spark, d), "user_id", ["us", "event_id"], "header", "section", "General")
    return tl.changes(out.filter("event_type <> 'signup'"), "user_id", ["us", "event_id"], "section").select("user_id", "event_id", "section")


def sequential_reference_dedup(spark, d):
    return folds.reference_dedup(_events(spark, d), "user_id", ["us", "event_id"], "event_id", "value", 10.0)


def lookback5_first_hit(spark, d):
    """Each purchase of the stream against the five before it: the earliest of nearly equal value."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, d).withColumn("pos", F.row_number().over(w).cast("long")).withColumn("p", F.col("user_id") * 1_000_000 + F.col("pos"))
    near = (F.col("a.user_id") == F.col("b.user_id")) & (F.abs(F.col("a.value") - F.col("b.value")) <= 5)
    return folds.lookback(e.select("event_id", "user_id", "value", "p"), "p", "event_id", 5, near)


def minutes_seconds_autodetect(spark, d):
    """Slide times of a video are minutes if that brings their end nearer to the end of its lines."""
    img = table(spark, d, "img").select("video_id", F.coalesce("seconds", slide_seconds("filename")).alias("t")).groupBy("video_id").agg((F.max("t") / 60).alias("m"))
    html = table(spark, d, "html_data").select("video_id", offset_seconds("timestamp").alias("t")).groupBy("video_id").agg(F.max("t").alias("e"))
    j = img.join(html, "video_id")
    minutes = F.abs(F.col("m") * 60 - F.col("e")) < F.abs(F.col("m") - F.col("e"))
    return j.select("video_id", minutes.alias("in_minutes"), F.round(F.when(minutes, F.col("m") * 60).otherwise(F.col("m")), 4).alias("last_s"))


def timestamp_format_roundtrip(spark, d):
    s = F.col("event_id") * 37 % 200_000
    e = table(spark, d, "events").select("event_id", seconds_to_clock(s).alias("clock"), seconds_to_short_clock(s).alias("short"))
    return e.select("event_id", "clock", "short", clock_to_seconds("clock").alias("back"))


def slide_name_parse(spark, d):
    i = table(spark, d, "img").select("slide_id", "filename").distinct()
    return i.select("slide_id", F.round(slide_seconds("filename"), 6).alias("s"), F.round(slide_seconds("filename", minutes=True), 6).alias("m"))


def interpolated_times(spark, d):
    """Times of frames without stamps, evenly from 0 to the video's end."""
    w, whole = Window.partitionBy("video_id").orderBy("filename"), Window.partitionBy("video_id")
    i = table(spark, d, "img").select("video_id", "filename", F.coalesce("seconds", slide_seconds("filename")).alias("t")).distinct()
    i = i.groupBy("video_id", "filename").agg(F.max("t").alias("t"))
    i = i.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)).withColumn("end", F.max("t").over(whole))
    return i.select("video_id", "filename", F.round(F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) * F.col("end"), 4).alias("t"))


def first_middle_last(spark, d):
    w, whole = Window.partitionBy("user_id").orderBy("us", "event_id"), Window.partitionBy("user_id")
    e = _events(spark, d).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(whole))
    return e.filter((F.col("rn") == 1) | (F.col("rn") == F.floor(F.col("n") / 2) + 1) | (F.col("rn") == F.col("n"))).select("user_id", "event_id", F.col("rn").cast("int").alias("rn"))


def session_windows_30min(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "total")


def sliding_windows_1h_30min(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("at", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select((F.unix_micros("w.start") / 1_000_000).cast("long").alias("start_s"), "event_type", "n")


_ASOF = f"""with {_SLIDES}, m as (select l.user_id, l.line_id, l.t lt, s.event_id, s.t st, row_number() over (partition by l.line_id order by s.t desc, s.event_id desc) rn
  from lines l left join slides s on s.user_id = l.user_id and s.t <= l.t + 2.0)"""
_HEADED = """with h as (select *, epoch_us(ts) us, case when event_type = 'signup' then 'S' || event_id end header from events),
  f as (select *, coalesce(last_value(header ignore nulls) over (partition by user_id order by us, event_id rows between unbounded preceding and current row), 'General') section from h),
  b as (select * from f where event_type <> 'signup')"""
SLIDE_SQL = r"coalesce(seconds, try_cast(nullif(regexp_extract(filename, '_([0-9]+(?:\.[0-9]+)?)\.png$', 1), '') as double))"
OFFSET_SQL = r"""case when regexp_full_match(timestamp, '[\s\[(]*(?:\d+:)?\d+:\d{1,2}(?:[.,]\d+)?[\s\])]*') then
    coalesce(try_cast(nullif(regexp_extract(timestamp, '(?:(\d+):)?(\d+):(\d{1,2})', 1), '') as double), 0) * 3600 + try_cast(regexp_extract(timestamp, '(?:(\d+):)?(\d+):(\d{1,2})', 2) as double) * 60
    + try_cast(regexp_extract(timestamp, '(?:(\d+):)?(\d+):(\d{1,2})', 3) as double) + coalesce(try_cast('0.' || nullif(regexp_extract(timestamp, '[.,](\d+)', 1), '') as double), 0)
  when regexp_full_match(timestamp, '[\s\[(]*\d+(?:[.,]\d+)?\s*s[\s\])]*') then try_cast(replace(regexp_extract(timestamp, '(\d+(?:[.,]\d+)?)', 1), ',', '.') as double) end"""

QUERIES = {
    "interval_join_lines_to_slides": (lambda spark, d: _interval(spark, d), _interval_sql()),
    "interval_join_tail300": (lambda spark, d: _interval(spark, d, tail=300.0), _interval_sql(end="coalesce(nx, t + 300)")),
    "interval_join_head_inclusive": (lambda spark, d: _interval(spark, d, head_inclusive=True), _interval_sql(start="case when rn = 1 then '-infinity'::double else t end")),
    "asof_active_slide_tol2s": (asof_active_slide_tol2s, _ASOF + " select user_id, line_id, coalesce(event_id, -1) slide_id from m where rn = 1"),
    "asof_first_slide_fallback": (asof_first_slide_fallback, _ASOF + """, f as (select user_id, min(t) ft, arg_min(event_id, (t, event_id)) fs from slides group by 1)
        select m.user_id, line_id, coalesce(event_id, case when abs(ft - lt) <= 86400 then fs end) slide_id from m left join f using (user_id) where rn = 1"""),
    "nearest_slide": (nearest_slide, f"""with {_SLIDES}, m as (select l.user_id, l.line_id, s.event_id, row_number() over (partition by l.line_id order by abs(s.t - l.t), s.t, s.event_id) rn
        from lines l left join slides s on s.user_id = l.user_id) select user_id, line_id, event_id slide_id from m where rn = 1"""),
    "band_self_join_pairs_600s": (band_self_join_pairs_600s, f"""with e as (select event_id, user_id, value, {_T} t from events)
        select a.user_id, a.event_id a_id, b.event_id b_id, round(b.t - a.t, 4) dt from e a join e b on a.user_id = b.user_id and (b.t > a.t or b.t = a.t and a.event_id < b.event_id) and b.t - a.t <= 600
        where abs(a.value - b.value) <= 40"""),
    "gap_analysis": (gap_analysis, f"""with g as (select user_id, {_T} - lag({_T}) over (partition by user_id order by ts, event_id) gap from events)
        select user_id, count(*) filter (gap < 3600) close_pairs, count(*) filter (gap > 86400) large_gaps, round(max(gap), 4) max_gap from g group by 1"""),
    "tumbling_5min_groups": (tumbling_5min_groups, f"""select user_id, floor({_T} / 300)::bigint bucket, count(*) n, string_agg(event_type, ' ' order by ts, event_id) as "text" from events group by 1, 2"""),
    "tumbling_daily_groups_dense": (tumbling_daily_groups_dense, f"""with b as (select user_id, floor({_T} / 86400)::bigint as "day", count(*) n from events group by 1, 2),
        s as (select user_id, unnest(range(min("day"), max("day") + 1)) as "day" from b group by 1) select s.user_id, s."day", coalesce(n, 0) n from s left join b on b.user_id = s.user_id and b."day" = s."day" """),
    "two_sided_buckets": (two_sided_buckets, f"""with i as (select user_id, floor({_T} / 3600)::bigint bucket, count(*) images from events where event_type = 'view' group by 1, 2),
        l as (select user_id, floor({_T} / 3600)::bigint bucket, count(*) lines, round(sum(value), 4) total from events where event_type = 'purchase' group by 1, 2)
        select user_id, bucket, coalesce(images, 0) images, coalesce(lines, 0) lines, total from i full join l using (user_id, bucket)"""),
    "section_forward_fill": (section_forward_fill, _HEADED + " select event_id, section from b"),
    "section_changes": (section_changes, _HEADED + """, c as (select *, lag(section) over (partition by user_id order by us, event_id) pv, row_number() over (partition by user_id order by us, event_id) rn from b)
        select user_id, event_id, section from c where rn = 1 or section is distinct from pv"""),
    "sequential_reference_dedup": (sequential_reference_dedup, """with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) rn from events),
        f as (select user_id, rn, event_id, event_id reference, value rv, false is_duplicate from e where rn = 1
        union all select e.user_id, e.rn, e.event_id, case when abs(e.value - f.rv) <= 10 then f.reference else e.event_id end, case when abs(e.value - f.rv) <= 10 then f.rv else e.value end, abs(e.value - f.rv) <= 10
        from f join e on e.user_id = f.user_id and e.rn = f.rn + 1) select user_id, event_id, reference, is_duplicate from f"""),
    "lookback5_first_hit": (lookback5_first_hit, """with e as (select *, row_number() over (partition by user_id order by ts, event_id) rn from events)
        select b.event_id, arg_min(a.event_id, a.rn) as "match" from e b left join e a on a.user_id = b.user_id and a.rn between b.rn - 5 and b.rn - 1 and abs(a.value - b.value) <= 5 group by 1"""),
    "minutes_seconds_autodetect": (minutes_seconds_autodetect, f"""with i as (select video_id, max({SLIDE_SQL}) / 60 m from img group by 1), h as (select video_id, max({OFFSET_SQL}) e from html_data group by 1)
        select video_id, abs(m * 60 - e) < abs(m - e) in_minutes, round(case when abs(m * 60 - e) < abs(m - e) then m * 60 else m end, 4) last_s from i join h using (video_id)"""),
    "timestamp_format_roundtrip": (timestamp_format_roundtrip, """with e as (select event_id, event_id * 37 % 200000 s from events)
        select event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) clock, case when s >= 172800 then (s // 86400) || ' days, ' when s >= 86400 then '1 day, ' else '' end
        || printf('%d:%02d:%02d', s // 3600 % 24, s // 60 % 60, s % 60) short, s::int back from e"""),
    "slide_name_parse": (slide_name_parse, rf"""with i as (select distinct slide_id, try_cast(nullif(regexp_extract(filename, '_([0-9]+(?:\.[0-9]+)?)\.png$', 1), '') as double) s from img)
        select slide_id, round(s, 6) s, round(s / 60, 6) m from i"""),
    "interpolated_times": (interpolated_times, f"""with i as (select video_id, filename, max({SLIDE_SQL}) t from img group by 1, 2),
        n as (select *, row_number() over (partition by video_id order by filename) - 1 k, count(*) over (partition by video_id) n, max(t) over (partition by video_id) e from i)
        select video_id, filename, round(k / greatest(n - 1, 1) * e, 4) t from n"""),
    "first_middle_last": (first_middle_last, """with e as (select *, row_number() over (partition by user_id order by ts, event_id) rn, count(*) over (partition by user_id) n from events)
        select user_id, event_id, rn::int rn from e where rn = 1 or rn = n // 2 + 1 or rn = n"""),
    "session_windows_30min": (session_windows_30min, """with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 1800000000 then 0 else 1 end first from events),
        s as (select *, sum(first) over (partition by user_id order by ts, event_id) sid from g)
        select user_id, min(epoch_us(ts)) start_us, count(*) n, round(sum(value), 4) total from s group by user_id, sid"""),
    "sliding_windows_1h_30min": (sliding_windows_1h_30min, """select unnest([(epoch_us(ts) // 1800000000) * 1800, (epoch_us(ts) // 1800000000) * 1800 - 1800])::bigint start_s, event_type, count(*) n from events group by 1, 2"""),
}
