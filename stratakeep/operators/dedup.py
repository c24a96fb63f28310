"""Which current parts can be linked to a stored one instead of being copied."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakeep.functions.names import effective_link_name, same_but_mutation


def considered(backups: DataFrame, since: datetime | str | None, enabled: bool = True) -> DataFrame:
    """Backups that may supply parts: started at `since` or later and with data; none if dedup is off."""
    if not enabled:
        return backups.limit(0)
    out = backups.where(~F.coalesce("schema_only", F.lit(False)))
    return out if since is None else out.where(F.col("start_time") >= F.lit(since).cast("timestamp_ntz"))


def with_handled(databases: DataFrame, hostname: str) -> DataFrame:
    """(backup, database) rows with what newer backups have closed already.

    databases: (backup, database, hostname, state, start_time), also for databases without tables.
    replicated_closed: a newer created backup holds the database; other_closed: such a one from
    this host does. A backup's own state counts for older ones only.
    """
    newer = Window.partitionBy("database").orderBy(F.desc("start_time"), F.desc("backup")).rowsBetween(Window.unboundedPreceding, -1)
    created = F.col("state") == "created"
    return databases.withColumn("replicated_closed", F.coalesce(F.bool_or(created).over(newer), F.lit(False))).withColumn(
        "other_closed", F.coalesce(F.bool_or(created & (F.col("hostname") == hostname)).over(newer), F.lit(False))
    )


def candidates(parts: DataFrame, databases: DataFrame, backups: DataFrame, hostname: str) -> DataFrame:
    """One stored entry for each (database, table, part): the newest usable one.

    parts: (backup, database, table, engine, part, checksum, bytes, link, link_part_name, ...);
    databases as in with_handled, backups: those considered, (backup). Linked entries count only if
    their source is considered too; they need no verification. supplier is the backup whose
    storage holds the part.
    """
    closed = with_handled(databases.join(backups.select("backup"), "backup", "left_semi"), hostname)
    usable = parts.join(closed.select("backup", "database", "hostname", "start_time", "replicated_closed", "other_closed"), ["backup", "database"])
    replicated = F.contains("engine", F.lit("MergeTree")) & F.contains("engine", F.lit("Replicated"))
    usable = usable.where(F.when(replicated, ~F.col("replicated_closed")).otherwise(~F.col("other_closed") & (F.col("hostname") == hostname)))
    sources = backups.select(F.col("backup").alias("_source"))
    known = usable.join(sources, F.col("link") == F.col("_source"), "left").where(F.col("link").isNull() | F.col("_source").isNotNull()).drop("_source")
    first = Window.partitionBy("database", "table", "part").orderBy(F.desc("start_time"), F.desc("backup"))
    known = known.withColumn("supplier", F.coalesce("link", "backup")).withColumn("verified", F.col("link").isNotNull())
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "hostname", "start_time", "replicated_closed", "other_closed")


def matched(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Each current part with the one stored part of the same checksum, or no row.

    current: (database, table, part, checksum). Of several stored parts the one with the greatest
    supplier name stays; ties go to the same part name, then the least. The name is looked at
    afterwards: a top entry whose name differs in more than the mutation hides all others.
    Many parts may share a checksum (empty files do), so the stored ones are brought down to one a
    checksum before the join, and those of the same name are looked up by name: no pairs are built.
    """
    key = ["database", "table", "checksum"]
    rest = F.struct("verified", F.col("link_part_name").alias("stored_link_part_name"), F.col("bytes").alias("stored_bytes"))
    named = stored.groupBy(*key, "supplier", F.col("part").alias("stored_part")).agg(F.min(rest).alias("rest"))
    least = named.groupBy(*key, "supplier").agg(F.min(F.struct("stored_part", "rest")).alias("entry"))
    lead = least.groupBy(*key).agg(F.max(F.struct("supplier", "entry")).alias("lead")).select(*key, "lead.supplier", "lead.entry")
    of_name = named.select(*key, "supplier", F.col("stored_part").alias("current_part"), F.struct("stored_part", "rest").alias("_of_name"))
    pairs = current.select("database", "table", F.col("part").alias("current_part"), "checksum").join(lead, key)
    pairs = pairs.join(of_name, [*key, "supplier", "current_part"], "left").withColumn("entry", F.coalesce("_of_name", "entry"))
    top = pairs.select(*key, "current_part", "supplier", "entry.stored_part", "entry.rest.*")
    same = (F.col("stored_part") == F.col("current_part")) | F.coalesce(same_but_mutation(F.col("stored_part"), F.col("current_part")), F.lit(False))
    return top.where(same).withColumn("link_part_name", effective_link_name(F.col("stored_link_part_name"), F.col("stored_part"), F.col("current_part")))


def link_plan(current: DataFrame, stored: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(database, table, part, action, link, link_part_name): "link" to a supplier, or "upload".

    valid: (supplier, database, table, stored_part) whose objects were found whole in storage;
    matches that aren't verified must be among them. None takes all for whole.
    """
    found = matched(current, stored)
    if valid is not None:
        marked = valid.select("supplier", "database", "table", "stored_part").distinct().withColumn("_whole", F.lit(True))
        found = found.join(marked, ["supplier", "database", "table", "stored_part"], "left").where(F.col("verified") | F.col("_whole"))
    found = found.select("database", "table", F.col("current_part").alias("part"), F.col("supplier").alias("link"), "link_part_name")
    out = current.select("database", "table", "part").join(found, ["database", "table", "part"], "left")
    return out.select("database", "table", "part", F.when(F.col("link").isNull(), "upload").otherwise("link").alias("action"), "link", "link_part_name")
