"""Catalogue relations derived from the driver's tables, the same in Spark and in DuckDB (the SQL constants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakeep.sources.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INV = """inv AS (
  SELECT strftime(l_shipdate, '%Y%m') AS ym, l_orderkey % 4 AS b, count(*) AS n,
         md5(count(*) || ':' || sum(CAST('0x' || left(md5(l_orderkey || ':' || l_linenumber), 15) AS BIGINT))) AS checksum
  FROM lineitem GROUP BY 1, 2
), parts AS (
  SELECT 'sales' AS database, CASE WHEN b % 2 = 0 THEN 'lineitem' ELSE 'lineitem_local' END AS "table",
         CASE WHEN b % 2 = 0 THEN 'ReplicatedMergeTree' ELSE 'MergeTree' END AS engine,
         ym || '_' || (b + 1) || '_' || (b + 1) || '_0' AS part, ym, CAST(left(ym, 4) AS INT) AS y, b, n * 64 AS bytes, checksum
  FROM inv
)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current data parts: one for each month and orderkey mod 4 of lineitem.

    The checksum is of the number and the sum of the rows' own digests (60 bits each), whatever
    their order, so a part of any size is aggregated before the shuffle and no task holds its rows.
    """
    row = F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    total = F.sum(F.conv(F.left(row, F.lit(15)), 16, 10).cast("decimal(28,0)"))
    checksum = F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string")))
    inv = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").alias("ym"), (F.col("l_orderkey") % 4).alias("b")).agg(F.count(F.lit(1)).alias("n"), checksum.alias("checksum"))
    even, k = F.col("b") % 2 == 0, (F.col("b") + 1).cast("string")
    return inv.select(
        F.lit("sales").alias("database"), F.when(even, "lineitem").otherwise("lineitem_local").alias("table"),
        F.when(even, "ReplicatedMergeTree").otherwise("MergeTree").alias("engine"), F.concat_ws("_", "ym", k, k, F.lit("0")).alias("part"),
        "ym", F.left("ym", F.lit(4)).cast("int").alias("y"), "b", (F.col("n") * 64).alias("bytes"), "checksum",
    )


def parts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts, worked out once and kept for all that a query makes of them: lineitem is scanned once."""
    return stored(parts(spark, sf_dir), "parts")


SNAP = INV + """, years AS (SELECT DISTINCT y FROM parts),
catalog AS (
  SELECT 'b' || y AS backup, 'host' || (y % 2) AS hostname, CASE WHEN y % 3 = 0 THEN 'failed' ELSE 'created' END AS state,
         make_timestamp(y + 1, 1, 1, 0, 0, 0) AS start_time, FALSE AS schema_only, y
  FROM years
), snap AS (
  SELECT 'b' || c.y AS backup, p.database, p."table", p.engine, p.part, p.checksum, p.bytes, p.ym, p.b,
         CASE WHEN p.y < c.y THEN 'b' || p.y END AS link,
         CASE WHEN p.y < c.y AND p.b = 3 THEN p.part || '_1' END AS link_part_name
  FROM parts p JOIN catalog c ON p.y <= c.y
)"""


def catalog(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """One backup a year; known: parts that are at hand."""
    y = F.col("y")
    return (parts(spark, sf_dir) if known is None else known).select("y").distinct().select(
        F.concat(F.lit("b"), y).alias("backup"), F.concat(F.lit("host"), y % 2).alias("hostname"), F.when(y % 3 == 0, "failed").otherwise("created").alias("state"),
        F.make_timestamp_ntz(y + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start_time"), F.lit(False).alias("schema_only"), "y",
    )


def snap(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Stored parts: each backup holds all parts up to its year, older ones as links; known: parts that are at hand."""
    p = parts(spark, sf_dir) if known is None else known  # planned twice, exchanged once
    years = p.select(F.col("y").alias("backup_year")).distinct()
    # each part year with the years it is stored in: few rows, so that the parts join on equality
    held = years.select(F.explode(F.sequence(F.lit(1970), "backup_year")).alias("y"), "backup_year")
    old = F.col("y") < F.col("backup_year")
    return p.join(held, "y").select(
        F.concat(F.lit("b"), "backup_year").alias("backup"), "database", "table", "engine", "part", "checksum", "bytes", "ym", "b",
        F.when(old, F.concat(F.lit("b"), "y")).alias("link"), F.when(old & (F.col("b") == 3), F.concat("part", F.lit("_1"))).alias("link_part_name"),
    )


BACKUPS = """backups AS (
  SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS name, ts AS start_time, 'host' || (user_id % 3) AS hostname,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partially_deleted' ELSE 'created' END AS state, event_id, user_id, value
  FROM events
)"""


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One backup an event."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partially_deleted").otherwise("created")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("name"), F.col("ts").alias("start_time"),
        F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string")).alias("hostname"), state.alias("state"), "event_id", "user_id", "value",
    )
