"""Totals of backups: sizes, counts, and gates on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(parts: DataFrame) -> DataFrame:
    """(backup, size, real_size): bytes of all parts, and of those that aren't links."""
    own = F.when(F.col("link").isNull(), F.col("bytes"))
    return parts.groupBy("backup").agg(F.sum("bytes").alias("size"), F.coalesce(F.sum(own), F.lit(0)).alias("real_size"))


def counts(parts: DataFrame) -> DataFrame:
    """(backup, data_count, link_count)."""
    return parts.groupBy("backup").agg(F.count_if(F.col("link").isNull()).alias("data_count"), F.count("link").alias("link_count"))


def emptiness(backups: DataFrame, parts: DataFrame) -> DataFrame:
    """(backup, empty): whether a backup's parts hold no bytes, also for backups without parts."""
    held = parts.groupBy("backup").agg(F.sum("bytes").alias("_size"))
    return backups.select("backup").join(held, "backup", "left").select("backup", (F.coalesce("_size", F.lit(0)) == 0).alias("empty"))


def interval_gate(backups: DataFrame, now: datetime | str, seconds: int, by: list[str]) -> DataFrame:
    """(by, newest, allowed): whether the newest backup, of any state, ended at least `seconds` before now.

    A newest backup without an end time doesn't hold a new one back.
    """
    newest = F.max_by(F.struct("name", "end_time"), F.struct("start_time", "name")).alias("_newest")
    out = backups.groupBy(*by).agg(newest)
    allowed = F.col("_newest.end_time") + F.expr(f"INTERVAL {int(seconds)} SECOND") <= F.lit(now).cast("timestamp_ntz")
    return out.select(*by, F.col("_newest.name").alias("newest"), F.coalesce(allowed, F.lit(True)).alias("allowed"))


def skip_summary(tables: DataFrame, reason: str) -> DataFrame:
    """(reason, n) of skipped tables; no rows when nothing was skipped."""
    return tables.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def names_by_table(columns: DataFrame) -> DataFrame:
    """(table, columns): each table's column names as a sorted array."""
    return columns.groupBy("table").agg(F.array_sort(F.collect_list("column")).alias("columns"))


def object_counts(backups: DataFrame) -> DataFrame:
    """(name, acl_count, udf_count) of backups with lists access_control and functions; no list counts 0."""
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0)).cast("long")
    return backups.select("name", size(F.col("access_control").cast("array<string>")).alias("acl_count"), size(F.col("functions").cast("array<string>")).alias("udf_count"))


def holds(wanted: DataFrame, rows: DataFrame, key: list[str], out: str = "there", count: str = "n") -> DataFrame:
    """wanted with whether any rows have its key, and how many; rows are counted before they are joined."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias(count))
    return wanted.join(n, key, "left").withColumn(out, F.col(count).isNotNull()).withColumn(count, F.coalesce(count, F.lit(0)))


def partitions(parts: DataFrame, table: list[str], partition: str) -> DataFrame:
    """The distinct partitions of tables that have an active part (column active)."""
    return parts.where("active = 1").select(*table, partition).distinct()
