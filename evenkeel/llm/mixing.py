"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, form one stream that is cut into
blocks of equal size. The i-th block (from 0) of a source with weight w (its
share of all weights) may run from slot floor(i / w) and must have run by slot
ceil((i + 1) / w); in every slot the released block with the earliest deadline
runs. So a source never is a whole block away from its share. The weights are
taken as they are, as ratios of whole numbers, so nothing is rounded and no
period is repeated: one task goes through the slots and writes down each
block's. When a source ends, a new phase starts with the weights of those that
are left, so every document gets its place.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_SOURCES = 1 << 20
#: Most blocks beside the sources' last ones: a larger corpus gets larger blocks, as one task goes through them.
MOST_BLOCKS = 1 << 20
#: Blocks in a row of the table of places, and the most blocks for which that table is broadcast (24 bytes each).
RUN, SMALL_BLOCKS = 256, 2_000_000


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers that sum to ``period``, at least 1 each, by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratios of ``weights``."""
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def schedule(weight: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """``(source, block, release, deadline)`` of each slot in turn, without end; earliest deadline first among released blocks."""
    total = sum(weight.values())
    waiting = [(0, s, 0) for s in weight]
    heapq.heapify(waiting)
    ready: list = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weight[s]), s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        yield s, i, release, deadline
        heapq.heappush(waiting, ((i + 1) * total // weight[s], s, i + 1))
        t += 1


def period_slots(quota: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in the first ``sum(quota)`` slots."""
    slots: dict[str, list[int]] = {s: [] for s in quota}
    for t, (s, *_) in zip(range(sum(quota.values())), schedule(quota)):
        slots[s].append(t)
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, block, release, deadline, slot)`` slot after slot until all blocks have run."""
    left, slot = {s: n for s, n in blocks.items() if n > 0}, 0
    while left:
        base, first = slot, {s: blocks[s] - n for s, n in left.items()}
        active = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1.0)  # weight 0: after all others
        for s, i, release, deadline in schedule(whole(active)):
            yield s, first[s] + i, base + release, base + deadline, slot
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break


def places(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """The schedule as rows ``mix_source, mix_run, releases, deadlines, slots``, each of ``RUN`` blocks of a source.

    One task works it out and hands it on as it goes; it holds the unfinished
    rows (one per source) and some finished ones.
    """
    fields = ["mix_source", "mix_run", "releases", "deadlines", "slots"]

    def batch(rows):
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), longs, longs, longs])], fields)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part, full = {}, []
            for s, block, *times in phases(blocks, weights):
                mine = part.setdefault(s, ([], [], []))
                for x, t in zip(mine, times):
                    x.append(t)
                if (block + 1) % RUN == 0 or block + 1 == blocks[s]:
                    full.append((s, block // RUN, *part.pop(s)))
                if len(full) == 256:
                    yield batch(full)
                    full = []
            if full:
                yield batch(full)

    return spark.range(0, 1, 1, 1).mapInArrow(run, "mix_source string, mix_run long, releases array<long>, deadlines array<long>, slots array<long>")


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = 65_536, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, power: float = 0.5, nested: bool = False) -> DataFrame:
    """All rows of ``df`` with ``mix_source, start, block, release, deadline, slot``.

    ``weights`` are targets by source; a source without one gets the least
    positive one, and a source of weight 0 comes after all others. Without any
    weights sources get the power ``power`` of their bytes, so that small
    sources come up more often than they would by size. Within a phase each source has, after
    any number of slots, run its share of them to less than one block. A null source is a source named
    "<null>". A text counts its bytes, an empty or null one 1. Order the rows by
    ``slot, start`` to get the mixture. Repeated rows (of one id and text)
    lie side by side, in any order. A
    source's stream is ordered by a hash of id and text, in ranges that are
    summed first, so a source with most rows is no single task. Only one row
    per source (``MAX_SOURCES`` at most, else an error) comes to the driver.
    Blocks hold ``block_bytes``, and more where the corpus would have over
    ``MOST_BLOCKS``: the schedule's work is bounded whatever the corpus holds,
    and the deviation stays below one block (0.1 GB for 100 TB).
    Columns of ``df`` with the names added here give way to them; with
    ``nested`` the row of ``df`` comes whole, as a struct ``row``.
    """
    spark = df.sparkSession
    d = df.select(F.struct("*").alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("<null>")).alias("mix_source"),
                  F.greatest(F.lit(1), F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("mix_size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("mix_key"))
    total = d.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(total) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {r["mix_source"]: r["bytes"] for r in total}
    block_bytes = max(block_bytes, -(-sum(size.values()) // MOST_BLOCKS))
    given = weights or {}
    least = min([x for x in given.values() if x > 0], default=1.0)
    w = {s: float(given.get(s, least if given else b**power)) for s, b in size.items()}
    blocks = {s: -(-b // block_bytes) for s, b in size.items()}
    plans = places(spark, blocks, w)

    bits = max(0, math.ceil(math.log2(max(1, sum(r["n"] for r in total)) / 4096)))
    d = d.withColumn("mix_range", F.shiftrightunsigned("mix_key", 64 - bits) if bits else F.lit(0).cast("long"))
    ranges = d.groupBy("mix_source", "mix_range").agg(F.sum("mix_size").alias("mix_sum"))
    before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("mix_source", "mix_range", F.coalesce(F.sum("mix_sum").over(before), F.lit(0)).alias("mix_before"))
    inside = Window.partitionBy("mix_source", "mix_range").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("mix_inside", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    d = d.join(ranges, ["mix_source", "mix_range"]).withColumn("start", F.col("mix_before") + F.col("mix_inside"))
    d = d.withColumn("block", F.floor(F.col("start") / block_bytes).cast("long")).withColumn("mix_run", F.floor(F.col("block") / RUN).cast("long"))
    d = d.join(F.broadcast(plans) if sum(blocks.values()) <= SMALL_BLOCKS else plans.hint("merge"), ["mix_source", "mix_run"])
    at = (F.col("block") % RUN + 1).cast("int")
    d = d.select("row", "mix_source", "start", "block", F.element_at("releases", at).alias("release"), F.element_at("deadlines", at).alias("deadline"), F.element_at("slots", at).alias("slot"))
    made = ["mix_source", "start", "block", "release", "deadline", "slot"]
    return d.select("row", *made) if nested else d.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in made], *made)
