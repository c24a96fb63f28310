"""Mixing sources to target weights by Pfair scheduling (operator 8), in DataFrame operations only.

A source's documents, in doc_id order, make a stream that is cut into blocks of equal size. With
integer weights that sum to Q, block i of a source of weight w may take a slot from
floor(i * Q / w) on and must have one before ceil((i + 1) * Q / w); earliest deadline first fills
the slots. Then no source is ever a whole block ahead of its share or behind it. Targets that are
thousandths are taken as they are (Q = 1000), others in parts of 10 ** 9, so that among n slots a
source is n / 10 ** 9 blocks off its target at most. The schedule repeats after Q slots; it is
worked out on the driver for Q slots, or for those of the whole mix if these are fewer, and joined
as a table of blocks. A block has 50,000 characters, or more where the documents would make over
MOST_BLOCKS of them, so that this work doesn't grow with the data: a block is then that share of it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakeep.llm.store import materialise

MOST_SOURCES = 20_000
#: Blocks of documents that a mix has at most, about, and characters of one at least, unless block_chars says otherwise.
MOST_BLOCKS, LEAST_BLOCK = 200_000, 50_000
COARSE, FINE = 1000, 10**9


def integer_weights(weights: Mapping[str | None, float], slots: int | None = None) -> dict[str | None, int]:
    """Whole weights that sum to `slots`, by largest remainder (ties by name); 0 for a weight of 0.

    A weight that comes to less than half a slot still gets one, from the greatest weight.
    """
    slots = slots or max(1000, 4 * len(weights))
    parts = {s: Fraction(w) for s, w in weights.items()}
    total = sum(parts.values())
    if total <= 0 or len(weights) > slots or min(parts.values()) < 0:
        raise ValueError("weights must be non-negative, not all zero, and no more than the slots")
    exact = {s: w * slots / total for s, w in parts.items()}
    whole = {s: int(x) for s, x in exact.items()}
    order = sorted(whole, key=lambda s: (whole[s] - exact[s], s is not None, s))
    for s in order[: slots - sum(whole.values())]:
        whole[s] += 1
    for s in [s for s, w in parts.items() if w and not whole[s]]:
        whole[s] = 1
        whole[max(whole, key=lambda x: (whole[x], x is not None, x))] -= 1
    return whole


def target_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole weights in thousandths if the targets are, and else in parts of 10 ** 9."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    total = sum(parts.values())
    exact = total > 0 and len(parts) <= COARSE and all((COARSE * w) % total == 0 for w in parts.values())
    return integer_weights(weights, COARSE if exact else FINE)


def pattern(weights: Mapping[str | None, int], length: int | None = None) -> dict[str | None, list[int]]:
    """The slots of each source within one period, or its first `length` slots, by earliest deadline first among released blocks."""
    period = sum(weights.values())
    length = period if length is None else min(length, period)
    names = sorted(weights, key=lambda s: (s is not None, s))
    coming = [(0, k, 0) for k, s in enumerate(names) if weights[s]]  # release, source, block: the next one of each source
    ready, slots = [], {s: [] for s in weights}
    for t in range(length):
        while coming and coming[0][0] <= t:
            _, k, i = coming[0]
            w = weights[names[k]]
            heapq.heappush(ready, (-(-(i + 1) * period // w), k, i))
            heapq.heapreplace(coming, ((i + 1) * period // w, k, i + 1))
        deadline, k, _ = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        slots[names[k]].append(t)
    return slots


def source_sizes(docs: DataFrame) -> dict[str | None, int]:
    """Characters of each source (a document counts one more); as many rows as sources, which is checked."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(_size()).alias("n"))
    rows = sizes.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them before mixing")
    return {r.source: r.n for r in rows}


def _size():
    return F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int | None = None, temperature: float = 0.7) -> DataFrame:
    """The mix's place of each document: one row for each distinct (doc_id, source) of docs.

    Columns: doc_id, source, weight (of the period's slots), period, before (characters of the
    source in front of it), block (of block_chars characters), release, deadline, slot (of its first pass), blocks (of its
    source), passes. weights: targets by source; by default the sources' sizes to the power
    `temperature`, which lifts small sources. Sources without a weight get none and are an error.
    Those of weight 0 get no slot: release, deadline and slot are null, passes is 0.

    The mix is as long as it takes for every other source to be gone through once: nothing of these is dropped,
    and a source that the targets ask more of than it has is gone through again (passes).
    Null sources are a source of their own, null doc_ids come first, rows alike in doc_id and
    source stay together. An empty table gives no rows.
    """
    return _schedule(docs, weights, block_chars, temperature)[0]


def _schedule(docs: DataFrame, weights: Mapping[str | None, float] | None, block_chars: int | None, temperature: float) -> tuple[DataFrame, DataFrame]:
    """The places, and the table of slots (slot_source, number, slot): those of the period, or of the mix."""
    sizes = source_sizes(docs)
    if weights is None:
        weights = {s: n**temperature for s, n in sizes.items()}
    if missing := set(sizes) - set(weights):
        raise ValueError(f"sources without a weight: {sorted(map(str, missing))[:5]}")
    whole = target_weights({s: weights[s] for s in sizes}) if sizes else {}
    block_chars = block_chars or max(LEAST_BLOCK, -(-sum(sizes.values()) // MOST_BLOCKS))
    blocks, period = {s: -(-n // block_chars) for s, n in sizes.items()}, sum(whole.values())
    slots = pattern(whole, max((-(-blocks[s] * period // w) for s, w in whole.items() if w), default=0))
    # the mix ends when every source has been gone through once
    end = max(((blocks[s] - 1) // w * period + slots[s][(blocks[s] - 1) % w] + 1 for s, w in whole.items() if w), default=0)
    wanted = {s: end // period * w + bisect_left(slots[s], end % period) for s, w in whole.items()}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, whole[s], period, blocks[s], wanted[s]) for s in whole], "mix_source string, weight long, period long, blocks long, wanted long")
    names = pa.array([s for s in whole for _ in slots[s]], pa.string())
    numbers, places = (pa.array([x for s in whole for x in f(slots[s])], pa.int64()) for f in (lambda x: range(len(x)), iter))
    table = spark.createDataFrame(pa.table({"slot_source": names, "number": numbers, "slot": places}))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size")).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.repartitionByRange(parts, "doc_id").withColumn("chunk", F.spark_partition_id()), "sizes")
    # how much of the source is in earlier chunks, and how much in front within the chunk
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(chunks, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    rows = rows.select("doc_id", "source", (F.col("ahead") + F.col("inside")).alias("before"))
    rows = rows.withColumn("block", F.expr(f"before div {int(block_chars)}"))
    # one row for each source, of which there are MOST_SOURCES at most
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rows = rows.withColumn("number", F.expr("block % nullif(weight, 0)"))
    rows = _with_slot(rows, table, "left")
    return rows.select(
        "doc_id", "source", "weight", "period", "before", "block",
        F.expr("block * period div nullif(weight, 0)").alias("release"),
        F.expr("((block + 1) * period + weight - 1) div nullif(weight, 0)").alias("deadline"),
        F.expr("block div nullif(weight, 0) * period + slot").alias("slot"),
        "blocks", F.expr("if(weight = 0, 0L, (wanted - block + blocks - 1) div blocks)").alias("passes"),
    ), table


def _with_slot(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """rows (source, number) with the slot in the period of that block of the source."""
    named = table.withColumnRenamed("number", "slot_number")
    return rows.join(named, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("number") == F.col("slot_number")), how)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int | None = None, temperature: float = 0.7) -> DataFrame:
    """docs in the order of the mix, each row as often as the mix goes through it; the same columns.

    The rows are range-partitioned and sorted by slot, so files written from it follow the mix.
    """
    plan, table = _schedule(docs, weights, block_chars, temperature)
    plan = plan.where("passes > 0").drop("slot").withColumn("turn", F.explode(F.expr("transform(sequence(0L, passes - 1), p -> block + p * blocks)")))
    plan = _with_slot(plan.withColumn("number", F.expr("turn % weight")), table, "inner").withColumn("slot", F.expr("turn div weight * period + slot"))
    plan = plan.select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.struct("slot", "before").alias("mix_place"))
    row = docs.select(F.col("doc_id").alias("d"), F.col("source").cast("string").alias("s"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.join(plan, F.col("d").eqNullSafe(F.col("mix_doc")) & F.col("s").eqNullSafe(F.col("mix_source")))
    ordered = joined.repartitionByRange("mix_place").sortWithinPartitions("mix_place")
    return ordered.select(*[F.col("row")[c].alias(c) for c in docs.columns])
