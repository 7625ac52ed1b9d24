"""Mixing sources to target weights.

Targets are shares of the mix's tokens. A source that runs out (all of its documents used ``max_repeats`` times) gives
what it has, and the others share the rest by their weights. Each source's documents, in an order fixed by a hash and
round after round, form a stream of blocks of BLOCK tokens; block k of a source with weight w may start at floor(k / w)
and must end by ceil((k + 1) / w), and the earliest deadline goes first. Such a schedule keeps every source within one
block of its share at any point of the mix, and a block has no more tokens than that however large the corpus is. The
uses of a document are the blocks of the schedule in which it begins.

The schedule is cut into rounds of ROUND slots. The driver runs it once for where each source stands before each round
(about three microseconds a block, a minute and a half for 3 x 10^13 tokens) and keeps one row for a round; tasks run the
rounds again for the blocks themselves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.tokens import count_tokens
from linkloom.session import materialize

#: most tokens of a block, least number of blocks (smaller ones where the corpus is small), slots of a round
BLOCK, BLOCKS, ROUND = 1 << 20, 2_048, 4_096
#: documents of a bucket for the running sums, about
BUCKET_DOCUMENTS = 20_000


def targets(sizes: dict[str, int], weights: dict[str, float], repeats: dict[str, int]) -> dict[str, int]:
    """Tokens wanted of each source: weight times the size of all sources together, as far as repeats allow.

    What a capped source cannot give goes to the others in proportion to their weights. Sources without tokens or
    with a weight of zero or less give nothing; a null or negative number of repeats counts as zero.
    """
    total = sum(sizes.values())
    open_ = {s: Fraction(weights[s]) for s in sizes if sizes[s] > 0 and (weights.get(s) or 0) > 0 and (repeats.get(s) or 0) > 0}
    wanted, rest = {s: Fraction(0) for s in sizes}, Fraction(total)
    while open_ and rest > 0:
        share = rest / sum(open_.values())
        capped = [s for s in open_ if open_[s] * share >= repeats[s] * sizes[s]]
        if not capped:
            wanted.update({s: w * share for s, w in open_.items()})
            break
        for s in capped:
            wanted[s] = Fraction(repeats[s] * sizes[s])
            rest -= wanted[s]
            del open_[s]
    return {s: round(t) for s, t in wanted.items()}


def edf_window(blocks: list[int], begin: int, end: int, gone: list[int]) -> list[tuple[int, int]]:
    """(source, block) for the slots from ``begin`` to ``end``: earliest deadline first among the released blocks.

    ``blocks`` are the blocks of all sources in the whole schedule, ``gone`` those that went before ``begin``. A source
    has one block that waits or is ready at a time, so these numbers are all that a schedule has to know of its past.
    """
    slots = sum(blocks)
    job = lambda s, k: (k * slots // blocks[s], -(-(k + 1) * slots // blocks[s]), s, k)
    waiting = [job(s, k) for s, k in enumerate(gone) if k < blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    order = []
    for slot in range(begin, end):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, s, k = heapq.heappop(ready)
        order.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, job(s, k + 1))
    return order


def round_starts(blocks: list[int], size: int) -> list[list[int]]:
    """Blocks of each source that have gone before each round of ``size`` slots."""
    slots, states = sum(blocks), [[0] * len(blocks)]
    for at in range(0, slots - size, size):
        gone = list(states[-1])
        for s, k in edf_window(blocks, at, at + size, gone):
            gone[s] = k + 1
        states.append(gone)
    return states


class Mix:
    """The mix of ``documents`` (doc_id, source, text) by ``mix_targets`` (source, weight, max_repeats).

    Documents of sources without a row and documents without tokens (null or empty text) stay out. Rows of
    ``mix_targets`` with a null source are ignored; of repeated rows the one with the greatest weight holds.
    """

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, vocabulary: str = "byte_bpe_50k.json"):
        goal = mix_targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("g"))
        # one row for each source to be mixed, a list that is given by hand
        rows = {r["source"]: r["g"] for r in goal.collect()}
        self.weights = {s: r["weight"] or 0.0 for s, r in rows.items()}
        self.repeats = {s: max(0, r["max_repeats"] or 0) for s, r in rows.items()}
        chosen = documents.select("doc_id", "source", "text").filter(F.col("source").isin(list(rows)))
        counted = count_tokens(chosen, ["doc_id", "source"], vocabulary=vocabulary).filter("tokens > 0")
        self.counted = materialize(counted.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id")), "token-counts")
        self.spark = documents.sparkSession
        # one row for each source
        self.sizes = dict.fromkeys(rows, 0) | {r["source"]: r["n"] for r in self.counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        self.targets = targets(self.sizes, self.weights, self.repeats)
        self.sources = sorted(s for s in rows if self.targets[s] > 0)
        self.block = max(1, min(BLOCK, sum(self.targets.values()) // BLOCKS))
        self.blocks = [-(-self.targets[s] // self.block) for s in self.sources]

    def _placed(self) -> DataFrame:
        """Every document with ``begin``, its place in its source's stream, and the source's size and target.

        Running sums go over buckets of the hash, of which there are as many as BUCKET_DOCUMENTS asks for, so that the
        largest source is spread like the others; the sums of the buckets are summed up in a second step.
        """
        bits = max(1, math.ceil(math.log2(max(2, self.counted.count() / BUCKET_DOCUMENTS))))
        docs = self.counted.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        goals = self.spark.createDataFrame([(s, self.sizes[s], self.targets[s]) for s in self.sources], "source string, size bigint, target bigint")
        within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        docs = docs.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        docs = docs.join(offsets, ["source", "bucket"]).join(F.broadcast(goals), "source")  # goals: one row for each source
        return docs.withColumn("begin", F.col("offset") + F.col("inside"))

    def schedule(self) -> DataFrame:
        """source, block and slot of every block of the mix."""
        sources, blocks = self.sources, self.blocks
        slots = sum(blocks)
        rounds = [(i * ROUND, min(slots, (i + 1) * ROUND), gone) for i, gone in enumerate(round_starts(blocks, ROUND)) if slots]
        starts = self.spark.createDataFrame(rounds, "begin bigint, end bigint, gone array<bigint>")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    order = edf_window(blocks, row.begin, row.end, list(row.gone))
                    yield pd.DataFrame({"source": [sources[s] for s, _ in order], "block": [k for _, k in order], "slot": range(row.begin, row.end)})

        return starts.mapInPandas(run, "source string, block bigint, slot bigint")

    def order(self) -> DataFrame:
        """The mix in its order: slot, source, doc_id, repeat (from 0), tokens, at; one row for each use.

        A document belongs to the block in which it begins; inside of a slot the stream's order holds. The stream ends
        at the document whose middle passes the target, so that a source misses its target by half a document at most.
        """
        docs = self._placed().withColumn("repeat", F.explode(F.expr("sequence(0, cast(target div size as int))")))
        placed = docs.withColumn("at", F.col("repeat") * F.col("size") + F.col("begin")).filter(F.col("at") * 2 + F.col("tokens") <= F.col("target") * 2)
        placed = placed.withColumn("block", F.expr(f"at div {self.block}"))
        return placed.join(self.schedule(), ["source", "block"]).select("slot", "source", "doc_id", "repeat", "tokens", "at")

    def uses(self) -> DataFrame:
        """doc_id, uses (int, above zero), source and tokens of every document of the mix, counted in the schedule."""
        return self.order().groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).cast("int").alias("uses")).select("doc_id", "uses", "source", "tokens")

    def report(self) -> DataFrame:
        """For each source: tokens, target_share (its weight), planned_share (after caps) and actual_share."""
        got = self.uses().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
        total = sum(self.targets.values()) or 1
        goals = self.spark.createDataFrame([(s, float(self.weights[s]), self.targets[s] / total) for s in self.sizes], "source string, target_share double, planned_share double")
        rows = goals.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
        everything = Window.partitionBy()  # one row for each source
        return rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(everything)), F.lit(0.0)))
