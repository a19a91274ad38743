"""Queries that run ``events`` as a stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.session import Scratch
from quillstream.sources.tables import table
from quillstream.streaming import events as ev
from quillstream.streaming.files import run_to_end, table_stream


def stream_tumbling_counts(spark, d):
    """Every window, the last ones included: complete mode, into a table of its own."""
    scratch = Scratch(spark, "stream")
    counts = ev.bucket_counts(table_stream(spark, d, "events"), "ts", ["event_type"])
    out = scratch.path("counts")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).foreachBatch(
        lambda b, i: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def stream_dedup(spark, d):
    """First events of each user and type; the delay covers the whole stream."""
    s = table_stream(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    kept = ev.first_within(s, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type")
    return run_to_end(kept, Scratch(spark, "stream"), "dedup")


def stream_reference_dedup(spark, d):
    s = table_stream(spark, d, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return run_to_end(ev.kept_references(s, "user_id", "us", "event_id", "value", 10.0), Scratch(spark, "stream"), "fold")


QUERIES = {
    "stream_tumbling_counts": (stream_tumbling_counts, "select epoch_us(time_bucket(interval 5 minutes, ts)) bucket, event_type, count(*) n from events group by 1, 2"),
    "stream_dedup": (stream_dedup, "select distinct user_id, event_type from events"),
    "stream_reference_dedup": (stream_reference_dedup, """with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) rn from events),
        f as (select user_id, rn, event_id, event_id reference, value rv, false is_duplicate from e where rn = 1
        union all select e.user_id, e.rn, e.event_id, case when abs(e.value - f.rv) <= 10 then f.reference else e.event_id end, case when abs(e.value - f.rv) <= 10 then f.rv else e.value end, abs(e.value - f.rv) <= 10
        from f join e on e.user_id = f.user_id and e.rn = f.rn + 1) select user_id, event_id, reference, is_duplicate from f"""),
}
