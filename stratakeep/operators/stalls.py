"""Polls that don't advance: run lengths by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.operators.prefix import ranges, running


def stalled(polls: DataFrame, by: list[str], order: list[str], pointer: str) -> DataFrame:
    """polls with stall_count: consecutive polls up to this one at which the pointer was what it was before.

    The first poll of a series counts as one already: what came before it is itself. The first
    column of `order` is a time or a number; a series is spread over its ranges, however long it is.
    """
    key = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(polls.dtypes)[order[0]].startswith("timestamp") else F.col(order[0]).cast("long")
    keyed, ties = ranges(polls.withColumn("_key", key), "_key", "_range"), order[1:]
    place = [F.col(c) for c in ("_key", *ties)]
    # the greatest of the rows in front is the one before; the greatest of those that moved is where the run begins
    seen = running(keyed, by, "_key", ties, dealt="_range", _before=(F.max, F.struct(*place, F.col(pointer).alias("_pointer")), False), _number=(F.sum, F.lit(1), True))
    moved = F.col("_before").isNotNull() & ~F.col("_before._pointer").eqNullSafe(F.col(pointer))
    runs = running(seen.withColumn("_moved", F.when(moved, F.col("_number"))), by, "_key", ties, dealt="_range", _begin=(F.max, F.col("_moved"), True))
    return runs.select(*[F.col(f"`{c}`") for c in polls.columns], (F.col("_number") - F.coalesce("_begin", F.lit(0))).alias("stall_count"))
