"""Running totals over a whole table without a single-task window.

Rows are dealt into buckets by ranges of the order key. A window runs inside each bucket, and each
bucket's total is added to those after it; only one row a bucket is summed in sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Distinct quantiles of the order key, at most buckets - 1."""
    shares = [k / buckets for k in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, shares, 10_000).alias("q")).first() if shares else None
    return sorted(set(row.q)) if row is not None and row.q else []


def running_total(df: DataFrame, key: str, ties: list[str], value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """df with `out`: the sum of value over the rows in front, by ascending long `key`, then `ties` ascending.

    Equal keys share a bucket; rows alike in key and ties are taken in any order.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, key, buckets)
    bucket = F.lit(0)
    if bounds:
        bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(key)))
    dealt = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-1))).withColumn("_value", value.cast("long"))
    totals = dealt.groupBy("_bucket").agg(F.sum("_value").alias("_total"))
    # as many rows as there are buckets
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(F.broadcast(totals), "_bucket")
    return joined.withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_bucket", "_value", "_inside", "_ahead")


def ranges(df: DataFrame, key: str, out: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """df with the number of its range of the long `key`; null keys are a range before all others."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, key, buckets)
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    return df.withColumn(out, F.when(F.col(key).isNull(), -1).otherwise(bucket))


def running(df: DataFrame, by: list[str], key: str, ties: list[str], buckets: int | None = None, dealt: str | None = None, **values: tuple[Callable, Column, bool]) -> DataFrame:
    """df with running aggregates over the rows of a group (columns `by`), ascending in the long `key`, then `ties`.

    values: out=(aggregate, value, inclusive), with an aggregate such as F.sum, F.max or F.min that
    can be taken of its own results; it covers the rows in front, and the row itself if inclusive.
    dealt: a column with the range of each row, where `ranges` has worked it out already.

    A group of any size is spread over the ranges of the key: windows run inside a group's range,
    and what they add up to, one row for each, is what runs over the group. So a maximum of
    struct(key, ties, value) gives the value of the row in front.
    """
    rows = ranges(df, key, buckets=buckets) if dealt is None else df.withColumn("_bucket", F.col(dealt))
    names = {out: f"_value_{k}" for k, out in enumerate(values)}
    rows = rows.select("*", *[value.alias(names[out]) for out, (_, value, _) in values.items()])
    totals = rows.groupBy(*by, "_bucket").agg(*[fn(names[out]).alias(f"_total_{names[out]}") for out, (fn, _, _) in values.items()])
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(f"`{c}`").alias(f"_by_{k}") for k, c in enumerate(by)], F.col("_bucket").alias("_of"), *[fn(f"_total_{names[out]}").over(ahead).alias(f"_ahead_{names[out]}") for out, (fn, _, _) in values.items()])
    inside = Window.partitionBy(*by, "_bucket").orderBy(key, *ties)
    own = {out: fn(names[out]).over(inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)) for out, (fn, _, inclusive) in values.items()}
    rows = rows.select("*", *[c.alias(f"_inside_{names[out]}") for out, c in own.items()])
    same = reduce(and_, [rows[f"`{c}`"].eqNullSafe(totals[f"_by_{k}"]) for k, c in enumerate(by)], rows["_bucket"] == totals["_of"])
    joined = rows.join(totals, same)
    both = {out: fn for out, (fn, _, _) in values.items()}
    return joined.select(*[rows[f"`{c}`"] for c in df.columns], *[_of_two(both[out], F.col(f"_ahead_{names[out]}"), F.col(f"_inside_{names[out]}")).alias(out) for out in values])


def _of_two(aggregate: Callable, a: Column, b: Column) -> Column:
    """An aggregate's results for two runs of rows as one."""
    if aggregate is F.sum:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return (F.greatest if aggregate is F.max else F.least)(a, b)


def text_key(text: Column) -> Column:
    """A long that ascends as texts do by their bytes: the first seven of them. Texts alike so far have one key."""
    return F.conv(F.rpad(F.left(F.hex(F.encode(text, "UTF-8")), F.lit(14)), 14, "0"), 16, 10).cast("long")


def position(df: DataFrame, key: str, ties: list[str], out: str = "position") -> DataFrame:
    """df with each row's place, from 0."""
    return running_total(df, key, ties, F.lit(1), out)


def batches(df: DataFrame, key: str, ties: list[str], size: int, out: str = "batch") -> DataFrame:
    """df dealt into batches of `size` rows in order, numbered from 0."""
    return position(df, key, ties, "_at").withColumn(out, F.floor(F.col("_at") / size).cast("long")).drop("_at")
