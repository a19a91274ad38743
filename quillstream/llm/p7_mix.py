"""Problem 7: mixing sources to target weights.

Method: documents are put into seeded order within shards of bounded size and cut into blocks of equal token counts,
by running totals over all of a source's shards, so one block of a source may be short. The blocks of the mix are
apportioned to the sources by Sainte-Laguë's highest quotients, a shard of the mix after the other, so every shard of
the mix has an integer quota of each source. The quotas select the blocks: a source's blocks are dealt in a seeded
order, around again as often as its repeats allow, and the n-th one dealt belongs to the shard whose quota it falls
into. The place of a quotient among all of them has a closed form (:func:`seat`), so each block finds its shards alone,
without a sort or a join.

Defined results: documents without tokens, without source or of a source without target are not in the mix; a
source without documents gets nothing, and the others share its part in proportion; rows equal in id and text count
once; without any document the mix is empty and all reached shares are null.
"""

from __future__ import annotations

import heapq
import json
import random
from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.p6_encode import count_tokens
from quillstream.session import Scratch

# Targets are gathered on the driver: one row for each source.
MAX_SOURCES = 10_000
# Shares are whole parts of a million, so that quotients are compared exactly.
PARTS = 1_000_000


def sainte_lague(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Seats of each party by the highest quotients w / (2s + 1), none beyond its cap.

    Starts from a divisor that gives a few seats too few and deals the rest by quotients, so the cost doesn't
    grow with the seats. Ties go to the earlier party.
    """
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))
    given = lambda d: [min(c, int(w / d + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps)]
    out = [0] * len(weights)
    if seats and any(w > 0 for w in weights):
        low, high = 0.0, 4.0 * max(weights)
        for _ in range(200):
            mid = (low + high) / 2
            if sum(given(mid)) > seats:
                low = mid
            else:
                high = mid
        out = given(high)
    quotients = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(weights, out, caps)) if w > 0 and s < c]
    heapq.heapify(quotients)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(quotients)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(quotients, (-weights[i] / (2 * out[i] + 1), i))
    return out


def seat(weights: Sequence[int], caps: Sequence[int]) -> Column:
    """The place, from 0, at which block ``q`` (from 0) of source number ``i`` with ``weight`` is dealt, over columns
    of those names: the number of quotients before ``weight / (2q + 1)``, those of earlier sources first on ties, of a
    source as many as its cap. A rival's j-th quotient is before it if ``(2j + 1) * weight < w * (2q + 1)``."""
    rivals = json.dumps([{"i": i, "w": w, "c": c} for i, (w, c) in enumerate(zip(weights, caps)) if w > 0 and c > 0])
    before = "least(x.c, ((x.w * (2 * q + 1) - if(x.i < i, 0, 1)) div weight + 1) div 2)"
    return F.expr(f"aggregate(from_json('{rivals}', 'array<struct<i:int,w:bigint,c:bigint>>'), 0L, (n, x) -> n + {before})")


class Mix:
    """A mix of ``documents`` by ``targets(source, target_share, max_repeats)``.

    block_tokens: tokens of a block. shard_tokens: tokens of a shard of the input, and of the mix. total_tokens: size
    of the mix; by default the largest at which every source that has documents reaches its share. More than
    :data:`MAX_SOURCES` targets are an error.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 7, block_tokens: int = 1024, shard_tokens: int = 4_000_000, total_tokens: int | None = None):
        spark = docs.sparkSession
        scratch = Scratch(spark, "p7")
        rows = targets.filter("source is not null").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources with targets")
        want = {r["source"]: (max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0)) for r in rows}
        self.spark, self.names = spark, sorted(want)
        self.targets = spark.createDataFrame([(s, *want[s]) for s in self.names], "source string, target_share double, max_repeats int")

        counted = count_tokens(docs, keep=("source",)).filter("n_tokens > 0")
        counted = scratch.cut(counted.join(F.broadcast(self.targets.select("source")), "source"), "tokens")
        by_source = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        shards = sum(by_source.values()) // shard_tokens + 1
        put = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
        # One row per source and shard: the tokens of earlier shards come before those of a shard.
        sizes = put.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n"))
        before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        base = sizes.select("source", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
        begin = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = put.withColumn("begin", begin).join(base, ["source", "shard"])
        self._blocks = placed.select("doc_id", "source", "n_tokens", F.floor((F.col("base") + F.col("begin") + F.col("n_tokens") / 2) / block_tokens).alias("block"))

        have = {s: -(-n // block_tokens) for s, n in by_source.items()}
        weights = [round(want[s][0] * PARTS) if have.get(s) else 0 for s in self.names]
        caps = [have.get(s, 0) * want[s][1] for s in self.names]
        live = sum(w for w, c in zip(weights, caps) if c > 0)
        if total_tokens is None:
            seats = min((int(c * live / w) for w, c in zip(weights, caps) if w > 0 and c > 0), default=0)
        else:
            seats = total_tokens // block_tokens
        quota = sainte_lague(weights, caps, seats)
        self._plan = (weights, caps, sum(quota), max(1, shard_tokens // block_tokens))
        # A seeded order of a source's blocks: block b is dealt at step * b + first, modulo the number of blocks.
        rng = random.Random(seed)
        plan = []
        for i, s in enumerate(self.names):
            n = have.get(s, 0)
            first, step = rng.randrange(max(n, 1)), 1 + rng.randrange(max(1, min(n, 2**62 // max(n, 1)) - 1))
            while n and gcd(step, n) > 1:
                step -= 1
            plan.append((s, i, weights[i], quota[i], n, step, first))
        self.quota = spark.createDataFrame(plan, "source string, i int, weight long, quota long, blocks long, step long, first long")

    def placements(self) -> DataFrame:
        """``(doc_id, source, n_tokens, mix_shard, repeat)``: each document of the mix once for each time it is taken;
        repeat counts from 0."""
        weights, caps, seats, per = self._plan
        dealt = self._blocks.join(F.broadcast(self.quota), "source").withColumn("at", F.expr("(step * block + first) % blocks")).filter("at < quota")
        dealt = dealt.withColumn("repeat", F.explode(F.expr("sequence(0, cast((quota - 1 - at) div blocks as int))")))
        dealt = dealt.withColumn("q", F.col("at") + F.col("repeat") * F.col("blocks")).withColumn("seat", seat(weights, caps))
        return dealt.select("doc_id", "source", "n_tokens", F.floor(F.col("seat") / per).alias("mix_shard"), "repeat")

    def shard_quotas(self) -> DataFrame:
        """``(mix_shard, source, blocks)``: the integer quotas of each shard of the mix. The quotients are dealt in
        one sequence, so a shard's quotas are those up to its end less those up to its begin."""
        weights, caps, seats, per = self._plan
        names = self.names

        def deal(batches):
            import pandas as pd

            for batch in batches:
                for k in batch["id"]:
                    a = sainte_lague(weights, caps, min(seats, int(k) * per))
                    b = sainte_lague(weights, caps, min(seats, (int(k) + 1) * per))
                    yield pd.DataFrame({"mix_shard": [k] * len(names), "source": names, "blocks": [y - x for x, y in zip(a, b)]})

        return self.spark.range(-(-seats // per)).mapInPandas(deal, "mix_shard long, source string, blocks long")

    def shares(self) -> DataFrame:
        """``(source, target_share, max_repeats, docs, tokens, reached_share)`` of every source with a target."""
        got = self.placements().groupBy("source").agg(F.count_if(F.col("repeat") == 0).alias("docs"), F.sum("n_tokens").alias("tokens"))
        all_of = self.targets.join(F.broadcast(got), "source", "left").select(
            "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        # One row per source: the total may be taken over all of them.
        every = F.sum("tokens").over(Window.partitionBy())
        return all_of.withColumn("reached_share", F.try_divide(F.col("tokens").cast("double"), F.nullif(every.cast("double"), F.lit(0.0))))
