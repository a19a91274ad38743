"""Problem 4: matching records by nearest time, as a stateful streaming join.

Method: both sides are buffered per entity; a left row goes out once the entity's watermark has passed the time up to
which a partner may still come; candidates that no later row can reach are evicted. The watermark is kept for each
entity, as times count from the entity's own start: an endless entity would push a watermark of all past every short one.

The state is two tables below the shared folder, written anew by each micro-batch under its number: the clock of each
entity, and the rows still waited for or waiting. A batch that is run again reads the state before it, so it gives the
same; the loss of an executor costs the tasks it ran. An entity may be endless and hold most rows, so rows meet by the
entity and a stretch of time twice the tolerance long; right rows within tolerance of a border are in two stretches.

Defined results: rows without entity or time are left out; repeated rows count once; of equally near partners the
one of the lesser id is taken; a left row without partner comes out with nulls; an empty side leaves all unmatched.
A row that comes ``delay_s`` or more behind its entity's clock, when what it could meet is out or evicted, is late: it
is left out, and counted in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.timefns import offset_seconds, slide_seconds
from quillstream.session import Scratch
from quillstream.sources.tables import table

LEFT, RIGHT = 0, 1
FILE_ROWS = 5_000_000


def timed(rows: DataFrame, entity: Column, seconds: Column, ident: Column) -> DataFrame:
    """``(entity, us, id)``: the form in which either side enters the join; times count from the entity's start."""
    us = F.round(seconds * 1_000_000).cast("long")
    return rows.select(entity.alias("entity"), us.alias("us"), ident.alias("id")).filter("entity is not null and us is not null and id is not null")


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(side, entity, us, id)`` of either side, streams or tables."""
    return left.withColumn("side", F.lit(LEFT)).unionByName(right.withColumn("side", F.lit(RIGHT))).select("side", "entity", "us", "id")


# A right row is in the stretches that hold the times within tolerance of it; a left row is in one.
_NEAREST = """select li left_id, le entity, lt left_us, b.id right_id, b.d distance_us from (
  select le, lt, li, min(case when ri is not null then struct(abs(rt - lt) as d, ri as id) end) b
  from (select entity le, us lt, id li, floor(us / {width}) lb from {rows} where side = 0 and {ready}) l
  left join (select entity re, us rt, id ri, explode(array_distinct(array(floor((us - {tol}) / {width}), floor((us + {tol}) / {width})))) rb
    from {rows} where side = 1) r on le = re and lb = rb and abs(rt - lt) < {tol} group by le, lt, li)"""
_CLOCK = """select entity, max(was) was, greatest(max(was), max(us)) now from (
  select entity, now was, null us from {clock} union all select entity, null was, us from {fresh}) group by entity"""
# reach: how far ahead the clock must be for a row to be of no more use; a left row waits for its own horizon, a right
# row is met by left rows that wait for theirs.
_ROWS = """select side, entity, us, id, not late and passed and side = 0 ready, not late and not passed keep, late from (
  select side, entity, us, id, fresh and coalesce(reach < was - {delay}, false) late, reach < now - {delay} passed from (
    select side, entity, us, id, min(fresh) fresh, us + if(side = 0, {tol}, 2 * {tol}) reach from (
      select side, entity, us, id, false fresh from {rows} where keep union all select side, entity, us, id, true from {fresh})
    group by side, entity, us, id) join {clock} using (entity))"""


class NearestJoin:
    """The join over a stream of :func:`both_sides`; ``delay_s`` is how far behind its entity's clock a row may come.

    ``report`` has of each micro-batch the left rows that went out, the left rows and candidates that stay, and the
    late rows.
    """

    def __init__(self, spark: SparkSession, tolerance_s: float, delay_s: float = 0.0):
        self.spark, self.scratch = spark, Scratch(spark, "p4")
        self.tol, self.delay = int(tolerance_s * 1_000_000), int(delay_s * 1_000_000)
        self.report: dict[int, dict[str, int]] = {}

    def _at(self, what: str, batch: int) -> str:
        return f"{self.scratch.root}/{what}/{batch:09d}"

    def _state(self, spark: SparkSession, what: str, batch: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(self._at(what, batch)) if batch >= 0 else spark.createDataFrame([], schema)

    def _schemas(self, rows: DataFrame) -> tuple[str, str]:
        entity, ident = (rows.schema[c].dataType.simpleString() for c in ("entity", "id"))
        return f"entity {entity}, was bigint, now bigint", f"side int, entity {entity}, us bigint, id {ident}, ready boolean, keep boolean"

    def _nearest(self, rows: DataFrame, ready: str) -> DataFrame:
        return rows.sparkSession.sql(_NEAREST.replace("{ready}", ready).replace("{tol}", str(self.tol)).replace("{width}", str(2 * self.tol)), rows=rows)

    def advance(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: clocks forward, ready rows out, what no later row can reach evicted."""
        spark, (clocks, schema) = batch.sparkSession, self._schemas(batch)
        state = lambda what, n: self._state(spark, what, n, clocks if what == "clock" else schema)
        timed = lambda q: q.replace("{tol}", str(self.tol)).replace("{delay}", str(self.delay))
        spark.sql(_CLOCK, clock=state("clock", number - 1), fresh=batch).write.mode("overwrite").parquet(self._at("clock", number))
        rows = spark.sql(timed(_ROWS), rows=state("rows", number - 1), fresh=batch, clock=state("clock", number))
        seen = Observation()
        rows = rows.observe(seen, F.expr("count_if(ready) out"), F.expr("count_if(keep and side = 0) waiting"), F.expr("count_if(keep and side = 1) candidates"), F.expr("count_if(late) late"))
        rows.filter("not late").drop("late").write.mode("overwrite").parquet(self._at("rows", number))
        self.report[number] = seen.get
        self._nearest(state("rows", number), "ready").write.mode("overwrite").parquet(self._at("out", number))
        if number > 1:
            for what in ("clock", "rows"):
                self.scratch.delete(self._at(what, number - 2))

    def run(self, stream: DataFrame) -> DataFrame:
        """``(left_id, entity, left_us, right_id, distance_us)`` of every left row, after all input there is; what
        still waits then goes out."""
        query = stream.writeStream.foreachBatch(self.advance).option("checkpointLocation", f"{self.scratch.root}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        last = max(self.report, default=-1)
        self._nearest(self._state(self.spark, "rows", last, self._schemas(stream)[1]), "keep").write.mode("overwrite").parquet(self._at("out", last + 1))
        entity, ident = (stream.schema[c].dataType.simpleString() for c in ("entity", "id"))
        paths = [self._at("out", n) for n in [*self.report, last + 1]]
        return self.spark.read.schema(f"left_id {ident}, entity {entity}, left_us bigint, right_id {ident}, distance_us bigint").parquet(*paths)


def replay(spark: SparkSession, rows: DataFrame, scratch: Scratch, batches: int = 8) -> DataFrame:
    """A table of :func:`both_sides` as a stream, in the order of its times, in about ``batches`` micro-batches.

    Nothing is late then, and the state holds no more than the rows within reach of a batch's end. The stream takes
    files by their age, so the files get ages in the order of their times; a file system that keeps its own ages has
    them copied one after the other.
    """
    n = rows.count()
    each = max(1, -(-n // (batches * FILE_ROWS)))
    at = scratch.path("replay")
    rows.repartitionByRange(batches * each, "us").write.parquet(at)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(at)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
    start = fs.getFileStatus(files[0]).getModificationTime() if files else 0
    for i, f in enumerate(files):
        fs.setTimes(f, start + 1000 * (i - len(files)), -1)
    if any(fs.getFileStatus(f).getModificationTime() != start + 1000 * (i - len(files)) for i, f in enumerate(files)):
        at = scratch.path("replay-copied")
        for f in files:
            spark.read.parquet(f.toString()).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(at)


def match_nearest(spark: SparkSession, stream: DataFrame, tolerance_s: float, delay_s: float = 0.0) -> DataFrame:
    """Every left row of a stream of :func:`both_sides` with its nearest right row, or nulls."""
    return NearestJoin(spark, tolerance_s, delay_s).run(stream)


def entries_to_slides(spark: SparkSession, sf_dir: str, tolerance_s: float = 5.0, batches: int = 8) -> DataFrame:
    """Every readable entry of ``html_data`` with its nearest slide of ``img``, or null."""
    html, img = table(spark, sf_dir, "html_data"), table(spark, sf_dir, "img")
    left = timed(html, F.col("video_id"), offset_seconds("timestamp"), F.col("entry_id"))
    right = timed(img, F.col("video_id"), F.coalesce("seconds", slide_seconds("filename")), F.col("slide_id"))
    join = NearestJoin(spark, tolerance_s)
    return join.run(replay(spark, both_sides(left, right), join.scratch, batches))
