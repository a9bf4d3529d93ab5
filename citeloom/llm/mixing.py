"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a pseudo-random order, form blocks. Block j of a source with weight w may
start at floor(j / w) and must be done by ceil((j + 1) / w); every slot takes the released block with
the earliest deadline. The weights sum to one, so every deadline is met and no source is ever a
whole block ahead of or behind its share. Weights are whole numbers over a period, after which the
schedule repeats: the driver schedules one period, and Spark places every document by its rank.

Ranks come from fine hash buckets: counts of (source, bucket) give the offsets and a window ranks
within a bucket, so no task ever holds a source. Up to where the first source runs out (``in_mix``)
all target weights hold; from there the others go on by the same schedule, whose slots of sources that
have run out stay empty, that is at their weights renormalised. The period grows with the smallest
target weight, up to ``MOST_SLOTS``.

Defined results: a null source is the source "" ; sources without a target weight get no slot and
come with null slot and position and ``in_mix`` false; more than ``MOST_SOURCES`` of them are an error;
rows that repeat a doc_id (or have none) are ranked by a hash of all their columns, so that only rows
equal in all of them meet in one task; an empty table gives no rows; other columns are kept, temporary names start with
``__mix_``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8
PERIOD = 10_000
TEMPERATURE = 0.7
#: The schedule of a period is sent to all executors: at most this many sources, and slots unless more are asked for.
MOST_SOURCES = 100_000
MOST_SLOTS = 1_000_000
BUCKET_ROWS = 500


def quantized(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainders, one at least."""
    names = sorted(s for s, w in weights.items() if w > 0)
    if len(names) > MOST_SOURCES:
        raise ValueError(f"{len(names)} sources; the schedule takes {MOST_SOURCES}")
    if not names:
        return {}
    period, total = max(period, len(names)), sum(weights[s] for s in names)
    ideal = {s: weights[s] / total * period for s in names}
    slots = {s: max(1, int(ideal[s])) for s in names}
    spare = period - sum(slots.values())
    for s in sorted(names, key=lambda s: (slots[s] - ideal[s], s))[: max(0, spare)]:
        slots[s] += 1
    over = [(ideal[s] - slots[s], s) for s in names if slots[s] > 1]
    heapq.heapify(over)
    for _ in range(-spare):  # the ones raised to one slot took too many
        short, s = heapq.heappop(over)
        slots[s] -= 1
        if slots[s] > 1:
            heapq.heappush(over, (short + 1, s))
    return slots


def long_enough(weights: Mapping[str, float], period: int = PERIOD) -> int:
    """The period in which the smallest weight has a whole slot; ``MOST_SLOTS`` at most, ``period`` at least."""
    some = [w for w in weights.values() if w > 0]
    return max(period, min(MOST_SLOTS, ceil(sum(some) / min(some)))) if some else period


def schedule(slots: Mapping[str, int]) -> list[tuple[str, int]]:
    """For each slot of a period the source and which of its blocks, earliest deadline first."""
    period = sum(slots.values())
    waiting = [(0, -(-period // n), s, 0) for s, n in slots.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        deadline, s, j = heapq.heappop(ready)
        assert deadline > t, "a deadline was missed"
        out.append((s, j))
        if (j := j + 1) < slots[s]:
            heapq.heappush(waiting, (j * period // slots[s], -(-(j + 1) * period // slots[s]), s, j))
    return out


def tempered(counts: Mapping[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Target weights in proportion to count ** temperature: large sources are held back."""
    return {s: n**temperature for s, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``docs`` with slot, position and in_mix; ``position`` orders the mix."""
    spark = docs.sparkSession
    named = docs.withColumn("__mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    if weights is None:
        counts = {r[0]: r[1] for r in named.groupBy("__mix_source").count().limit(MOST_SOURCES + 1).collect()}
        weights = tempered(counts)
    else:
        asked = sorted(s for s, w in weights.items() if w > 0)
        if len(asked) > MOST_SOURCES:
            raise ValueError(f"{len(asked)} target weights; the schedule takes {MOST_SOURCES}")
        wanted = F.broadcast(spark.createDataFrame([(s,) for s in asked], "__mix_source string"))  # MOST_SOURCES rows at most
        counts = {r[0]: r[1] for r in named.join(wanted, "__mix_source", "left_semi").groupBy("__mix_source").count().collect()}
        weights = {s: weights[s] for s in counts}
    slots = quantized(weights, long_enough(weights, period))
    order = schedule(slots)
    period = len(order)
    after = {s: divmod(-(-counts[s] // block_rows), n) for s, n in slots.items()}  # round and block where a source has run out
    end = min((after[s][0] * period + t for t, (s, j) in enumerate(order) if after[s][1] == j), default=0)

    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    rest = [f"`{c}`" for c in docs.columns if c != "doc_id" and not re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    keyed = named.withColumn("__mix_order", F.xxhash64(F.lit(11), "doc_id", *rest)).withColumn("__mix_bucket", F.pmod(F.col("__mix_order"), F.lit(buckets)))
    sizes = keyed.groupBy("__mix_source", "__mix_bucket").count()
    before = Window.partitionBy("__mix_source").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__mix_source", "__mix_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__mix_offset"))
    share = spark.createDataFrame(sorted(slots.items()), "__mix_source string, __mix_slots long")
    offsets = offsets.join(F.broadcast(share), "__mix_source", "left")  # at most MOST_SOURCES rows

    inside = Window.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_order", "doc_id", *rest)
    ranked = keyed.withColumn("__mix_rank", F.row_number().over(inside) - 1).join(offsets, ["__mix_source", "__mix_bucket"])
    rank = F.col("__mix_offset") + F.col("__mix_rank")
    block = F.floor(rank / block_rows)
    blocked = ranked.withColumns({"__mix_rank": rank, "__mix_block": block}).withColumn("__mix_j", F.col("__mix_block") % F.col("__mix_slots"))
    names, places = [s for s, _ in order], [j for _, j in order]
    turns = pa.table({"__mix_source": pa.array(names, pa.string()), "__mix_j": pa.array(places, pa.int64()), "__mix_turn": pa.array(range(period), pa.int64())})
    placed = blocked.join(F.broadcast(spark.createDataFrame(turns)), ["__mix_source", "__mix_j"], "left")  # at most MOST_SLOTS rows, or the asked period
    slot = F.floor(F.col("__mix_block") / F.col("__mix_slots")) * period + F.col("__mix_turn")
    return placed.select(
        *docs.columns,
        slot.alias("slot"),
        (slot * block_rows + F.col("__mix_rank") % block_rows).alias("position"),
        F.coalesce(slot < end, F.lit(False)).alias("in_mix"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of the sources with a target weight, in the order of the mix, with the same columns."""
    placed = mix(docs.withColumnsRenamed({c: f"__mixin_{c}" for c in docs.columns if c in ("slot", "position", "in_mix")}), weights, block_rows)
    kept = placed.where(F.col("position").isNotNull()).repartitionByRange("position").sortWithinPartitions("position")
    clash = [f"__mixin_{c}" if c in ("slot", "position", "in_mix") else c for c in docs.columns]
    return kept.select(*[F.col(c).alias(d) for c, d in zip(clash, docs.columns, strict=True)])
