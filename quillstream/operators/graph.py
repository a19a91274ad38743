"""Connected components over an edge list, by star contraction.

Every round is two aggregations with map-side combine and two joins on the vertex, so no vertex, however many
neighbours it has, is gathered into one task; adaptive execution splits the join side of a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillstream.session import Scratch


def _star(pairs: DataFrame, keep: Column, with_center: bool) -> DataFrame:
    """Link the ``keep`` neighbours of each vertex ``u`` to the least of ``u`` and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_center:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def _jumped(forest: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """Each vertex of a forest ``(u, v)``, ``v`` the only parent of ``u``, with its root instead of its parent."""
    for _ in range(max_rounds):
        up = forest.select(F.col("u").alias("v"), F.col("v").alias("w"))
        seen = Observation()
        step = forest.join(up, "v", "left").observe(seen, F.count("w").alias("moved")).select("u", F.coalesce("w", "v").alias("v"))
        nxt = scratch.cut(step, "jumped")
        scratch.drop(forest)
        forest = nxt
        if not seen.get["moved"]:
            return forest
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def star_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges(u, v)`` with the least vertex of its component: ``(node, label)``.

    Large-star and small-star steps alternate until each vertex has one parent, less than itself; then vertices jump to
    the parents of their parents up to the roots, by one join a round. Self loops and nulls link nothing. Rounds grow
    with the logarithm of the longest chain.
    """
    cur = scratch.cut(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "forest")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"), with_center=False)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        found = Observation()
        nxt = scratch.cut(_star(down, F.lit(True), with_center=True).observe(found, F.count("*").alias("n")), "forest")
        n = found.get["n"]
        scratch.drop(cur)
        cur = nxt
        # A forest has as many edges as vertices with a parent; while edges become fewer it is none yet.
        if n == before and cur.groupBy("u").count().filter("count > 1").isEmpty():
            break
        before = n
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    cur = _jumped(cur, scratch, max_rounds)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def keep_first(labels: DataFrame) -> DataFrame:
    """``(keep, remove)`` of groups labelled by their least member: one row for each other member."""
    return labels.filter("node <> label").select(F.col("label").alias("keep"), F.col("node").alias("remove"))
