"""Which backups stay: retention, purging, and what a deletion may remove."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.operators.prefix import position, running_total

#: The states of a backup.
STATES = ("created", "creating", "deleting", "partially_deleted", "failed")


def newest_first(backups: DataFrame) -> DataFrame:
    return backups.orderBy(F.desc("start_time"), F.desc("name"))


def _age(backups: DataFrame) -> DataFrame:
    """With an order key that ascends from the newest; rows of one start_time are told apart by name, descending."""
    return backups.withColumn("_key", -F.unix_micros(F.col("start_time").cast("timestamp")))


def retention(backups: DataFrame, count: int | None = None, since: datetime | str | None = None) -> DataFrame:
    """backups with retained: fewer than `count` created ones are newer, or it started at `since` or later.

    Backups in other states are retained without being counted. None for count is 0.
    """
    created = F.when(F.col("state") == "created", 1).otherwise(0)
    # equal times: the greater name is the newer
    keyed = _age(backups)
    rank = keyed.withColumn("_name", F.col("name"))
    counted = running_total(_descending(rank), "_key", ["_order"], created, "_newer")
    keep = F.col("_newer") < (count or 0)
    if since is not None:
        keep = keep | (F.col("start_time") >= F.lit(since).cast("timestamp_ntz"))
    return counted.withColumn("retained", F.coalesce(keep, F.lit(False))).select(*backups.columns, "retained")


def _descending(keyed: DataFrame) -> DataFrame:
    """A tie-break that ascends as names descend: the complement of each code unit, shorter names last."""
    flipped = F.transform(F.split(F.hex(F.encode("_name", "UTF-8")), ""), lambda c: F.translate(c, "0123456789ABCDEF", "FEDCBA9876543210"))
    return keyed.withColumn("_order", F.concat(F.array_join(flipped, ""), F.lit("~")))


def purge_partial(backups: DataFrame, name: str | None = None) -> DataFrame:
    """backups with deleting: the named one, and every one that isn't created but for the newest overall."""
    at = position(_descending(_age(backups).withColumn("_name", F.col("name"))), "_key", ["_order"], "_at")
    deleting = (F.col("state") != "created") & (F.col("_at") > 0)
    if name is not None:
        deleting = deleting | (F.col("name") == name)
    return at.withColumn("deleting", deleting).select(*backups.columns, "deleting")


def _physical() -> Column:
    return F.coalesce(F.nullif(F.col("link_part_name"), F.lit("")), F.col("part"))


def references(parts: DataFrame, retained: DataFrame, deleting: DataFrame) -> DataFrame:
    """(backup, database, table, part) in deleting backups that parts of retained backups are stored in.

    parts: (backup, database, table, part, link, link_part_name); retained, deleting: (backup).
    """
    held = parts.where("link is not null").join(retained.select("backup"), "backup", "left_semi")
    held = held.join(deleting.select(F.col("backup").alias("link")), "link", "left_semi")
    return held.select(F.col("link").alias("backup"), "database", "table", _physical().alias("part")).distinct()


def deletable_parts(parts: DataFrame, deleting: DataFrame, refs: DataFrame) -> DataFrame:
    """Own parts of deleting backups that nothing retained refers to."""
    own = parts.where("link is null").join(deleting.select("backup"), "backup", "left_semi")
    return own.join(refs, ["backup", "database", "table", "part"], "left_anti")


def deletion_modes(deleting: DataFrame, refs: DataFrame) -> DataFrame:
    """(backup, mode, next_state): "full" without references, else "parts", which leaves it partially_deleted."""
    held = refs.select("backup").distinct().withColumn("_held", F.lit(True))
    out = deleting.select("backup").join(held, "backup", "left")
    mode = F.when(F.col("_held"), "parts").otherwise("full")
    return out.select("backup", mode.alias("mode"), F.when(F.col("_held"), F.lit("partially_deleted")).alias("next_state"))


def without_parts(parts: DataFrame, removed: DataFrame) -> DataFrame:
    """What a partially deleted backup still lists."""
    return parts.join(removed.select("backup", "database", "table", "part"), ["backup", "database", "table", "part"], "left_anti")
