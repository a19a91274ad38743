"""Problem 2: consolidating pairwise matches into groups.

Method: take the vertex of highest degree, grow its component by frontier joins breadth first, anti-join what was
reached, and label the rest, whose components are small, by minimum propagation over contracted stars.

Defined results: rows whose flag is null or false, with a missing, blank or equal side, link nothing; repeated pairs
in either order count once; names are compared trimmed and in lower case; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillstream.operators.graph import star_components
from quillstream.operators.sizes import SMALL_ROWS
from quillstream.session import Scratch


def image_name(c: str) -> Column:
    """A name without outer white space, in lower case."""
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def match_links(pairs: DataFrame) -> DataFrame:
    """The distinct links ``(a, b)``, ``a < b``, of the rows of ``duplicates`` that link two images."""
    named = pairs.filter(F.col("is_duplicate")).select(image_name("image1").alias("x"), image_name("image2").alias("y"))
    named = named.filter("x is not null and y is not null and x <> '' and y <> '' and x <> y")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _numbered(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Names with numbers in the order of the names, the links as numbers, and how many names there are. The least
    number of a group stands for its least name, and rounds move longs instead of strings."""
    links = scratch.cut(links, "named")
    names = links.select(F.col("a").alias("name")).unionByName(links.select(F.col("b").alias("name"))).distinct()
    seen = Observation()
    ids = scratch.cut(names.sort("name").select("name", F.monotonically_increasing_id().alias("id")).observe(seen, F.count("*").alias("n")), "names")
    u = ids.select(F.col("name").alias("a"), F.col("id").alias("u"))
    v = ids.select(F.col("name").alias("b"), F.col("id").alias("v"))
    return ids, scratch.cut(links.join(u, "a").join(v, "b").select("u", "v"), "links"), seen.get["n"]


@dataclass
class _Peeled:
    """What was reached from the hub: its levels as ``(id)``, its least vertex, the edges that were not used, in both
    directions, and whether all of the component was reached."""

    levels: list[DataFrame]
    least: int
    rest: DataFrame
    whole: bool

    @property
    def reached(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.levels)


def _peel(edges: DataFrame, scratch: Scratch, vertices: int, max_peel_rounds: int) -> _Peeled | None:
    """The component of the vertex of highest degree, level by level; None where there is no edge.

    A neighbour of a level is in that level, the one before or the next one, so what is new is told from two levels,
    and each level is written once. Used edges leave the rest as soon as a twentieth of all vertices was reached anew.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not top:
        return None
    hub = top[0]["u"]

    def level(ids: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return scratch.cut(ids.observe(seen, F.count("*").alias("n"), F.min("id").alias("least")), "level"), seen.get

    # The first step is a filter: the hub, which may have a third of all rows, never becomes a join key.
    frontier, found = level(both.filter(F.col("u") == hub).select(F.col("v").alias("id")).distinct())
    levels, least = [edges.sparkSession.createDataFrame([(hub,)], "id long"), frontier], min(hub, found["least"])
    rest, since = both.filter((F.col("u") != hub) & (F.col("v") != hub)), 0
    for _ in range(max_peel_rounds):
        near = frontier.select(F.col("id").alias("u"))
        step = rest.join(F.broadcast(near) if found["n"] <= SMALL_ROWS else near, "u").select(F.col("v").alias("id")).distinct()
        before, used = levels[-2], frontier
        frontier, found = level(step.join(used, "id", "left_anti").join(before, "id", "left_anti"))
        if not found["n"]:
            return _Peeled(levels, least, rest, True)
        levels.append(frontier)
        least, since = min(least, found["least"]), since + found["n"]
        if since * 20 >= vertices:
            gone = reduce(DataFrame.unionByName, levels[:-1]).select(F.col("id").alias("u"))
            rest, since = scratch.cut(rest.join(gone, "u", "left_anti"), "rest"), 0
    return _Peeled(levels, least, rest, False)


def group_links(links: DataFrame, scratch: Scratch, max_peel_rounds: int = 16) -> DataFrame:
    """``(group_name, name)`` of every end of ``links(a, b)``; the least name of a group stands for it.

    max_peel_rounds bounds the breadth-first rounds, not the result: a component longer than that is contracted
    to one vertex as far as it was reached, and the propagation finishes it.
    """
    ids, edges, vertices = _numbered(links, scratch)
    peeled = _peel(edges, scratch, vertices, max_peel_rounds)
    if peeled is None:
        return ids.select(F.col("name").alias("group_name"), "name")
    reached, least = peeled.reached.withColumn("in", F.lit(True)), peeled.least
    if peeled.whole:
        # No edge leaves what was reached.
        left = peeled.rest.filter("u > v").join(reached.select(F.col("id").alias("u")), "u", "left_anti")
    else:
        left = edges.join(reached.select(F.col("id").alias("u"), F.col("in").alias("iu")), "u", "left")
        left = left.join(reached.select(F.col("id").alias("v"), F.col("in").alias("iv")), "v", "left")
        left = left.filter("iu is null or iv is null").select(
            F.when(F.col("iu"), F.lit(least)).otherwise(F.col("u")).alias("u"),
            F.when(F.col("iv"), F.lit(least)).otherwise(F.col("v")).alias("v"))
    small = star_components(left, scratch)
    # Where the peeled part was finished by the propagation, its vertices take the label its root got there.
    root = least if peeled.whole else small.filter(F.col("node") == least).agg(F.coalesce(F.min("label"), F.lit(least)).alias("label")).first()["label"]
    # The name of the giant is a literal, so its label never is a join key; so with what was finished beside it.
    giant = reached.select("id").unionByName(small.filter((F.col("label") == root) & (F.col("node") != least)).select(F.col("node").alias("id")))
    title = ids.filter(F.col("id") == root).first()["name"]
    labels = small.filter(F.col("label") != root)
    roots = ids.select(F.col("id").alias("label"), F.col("name").alias("group_name"))
    others = labels.join(ids.withColumnRenamed("id", "node"), "node").join(roots, "label").select("group_name", "name")
    return others.unionByName(giant.join(ids, "id").select(F.lit(title).alias("group_name"), "name"))


def duplicate_groups(pairs: DataFrame, max_peel_rounds: int = 16) -> DataFrame:
    """``(group_image, image)`` of every linked image of ``duplicates``."""
    scratch = Scratch(pairs.sparkSession, "p2")
    out = group_links(match_links(pairs), scratch, max_peel_rounds)
    return out.select(F.col("group_name").alias("group_image"), F.col("name").alias("image"))
