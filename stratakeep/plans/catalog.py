"""The commands over a catalogue of backups. Each gives a DataFrame of what is, or of what must be done."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakeep.functions import names, sizes
from stratakeep.operators import dedup, reconcile, retention, totals
from stratakeep.operators.listing import first_of
from stratakeep.operators.prefix import batches
from stratakeep.sources.files import orphans

VERSION = "0.1.0"
#: Objects that one bulk deletion takes.
DELETE_BATCH = 1000


@dataclass
class Catalog:
    """backups: (name, hostname, state, start_time, end_time, schema_only); databases: (backup, database, ...);
    parts: (backup, database, table, engine, part, checksum, bytes, files, link, link_part_name, ...)."""

    backups: DataFrame
    databases: DataFrame
    parts: DataFrame

    def list_backups(self, state: str | None = "created") -> DataFrame:
        """Newest first, with totals; None lists all states."""
        b = self.backups if state is None else self.backups.where(F.col("state") == state)
        t = totals.sizes(self.parts).join(totals.counts(self.parts), "backup").withColumnRenamed("backup", "name")
        return retention.newest_first(b.join(t, "name", "left").fillna(0, ["size", "real_size", "data_count", "link_count"]))

    def resolve(self, name: str) -> str:
        """A backup's name; LAST is the newest."""
        row = retention.newest_first(self.backups).first() if name == "LAST" else self.backups.where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no backup {name}")
        return row.name

    def show(self, name: str, database: str | None = None, table: str | None = None) -> DataFrame:
        out = self.parts.where(F.col("backup") == self.resolve(name))
        if table is not None and database is None:
            raise ValueError("a table needs its database")
        out = out if database is None else out.where(F.col("database") == database)
        out = out if table is None else out.where(F.col("table") == table)
        if (database or table) and out.isEmpty():
            raise ValueError(f"nothing of {database}.{table or '*'} in {name}")
        return out

    def plan_backup(self, current: DataFrame, hostname: str, since: datetime | str | None = None, enabled: bool = True, valid: DataFrame | None = None, chunk: int = 8 << 20, most_chunks: int = 10_000) -> DataFrame:
        """Link or upload of each current part (database, table, part, checksum, bytes), with the upload's chunks."""
        named = self.backups.withColumnRenamed("name", "backup")
        used = dedup.considered(named, since, enabled)
        dbs = self.databases.select("backup", "database").join(used.select("backup", "hostname", "state", "start_time"), "backup")
        plan = dedup.link_plan(current, dedup.candidates(self.parts, dbs, used, hostname), valid)
        out = plan.join(current.select("database", "table", "part", "bytes"), ["database", "table", "part"])
        up = F.col("action") == "upload"
        size = sizes.upload_chunk_size(F.col("bytes"), chunk, most_chunks)
        return out.withColumn("chunk", F.when(up, size)).withColumn("multipart", F.when(up, sizes.is_multipart(F.col("bytes"), size)))

    def _deletions(self, marked: DataFrame, gone: str) -> DataFrame:
        deleting = marked.where(gone).select(F.col("name").alias("backup"))
        retained = marked.where(f"NOT ({gone})").select(F.col("name").alias("backup"))
        refs = retention.references(self.parts, retained, deleting)
        modes = retention.deletion_modes(deleting, refs)
        whole = modes.where("mode = 'full'").select("backup", F.lit("delete_backup").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("database", "table", "part")], "next_state")
        some = retention.deletable_parts(self.parts, modes.where("mode = 'parts'"), refs)
        some = some.select("backup", F.lit("delete_part").alias("action"), "database", "table", "part", F.lit(None).cast("string").alias("next_state"))
        mark = modes.where("mode = 'parts'").select("backup", F.lit("set_state").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("database", "table", "part")], "next_state")
        return whole.unionByName(some).unionByName(mark)

    def plan_purge(self, count: int | None = None, since: datetime | str | None = None, names: DataFrame | None = None) -> DataFrame:
        """Actions that leave what the retention policy keeps; without a policy there are none.

        names: (backup) of what has files; those without metadata go too, whatever their age.
        """
        if count is None and since is None:
            return self._deletions(self.backups.withColumn("retained", F.lit(True)), "NOT retained")
        plan = self._deletions(retention.retention(self.backups, count, since), "NOT retained")
        if names is None:
            return plan
        lost = orphans(names.where("backup is not null").distinct(), self.backups).withColumn("action", F.lit("delete_backup"))
        return plan.unionByName(lost, allowMissingColumns=True)

    def plan_delete(self, name: str, purge_partial: bool = False) -> DataFrame:
        name = self.resolve(name)
        marked = retention.purge_partial(self.backups, name) if purge_partial else self.backups.withColumn("deleting", F.col("name") == name)
        return self._deletions(marked, "deleting")

    def plan_restore(self, name: str, wanted: DataFrame, live: DataFrame, state: DataFrame, keep_going: bool = False) -> DataFrame:
        """Ordered table actions, each with its parts still to fetch.

        wanted: (database, table, engine, uuid, statement) as stored, statement null where it is
        missing; live: the same of the server; state: (database, table, part, state) of earlier tries.
        """
        order = ["database", "table"]
        judged = reconcile.first_of_uuid(wanted, order)
        if not keep_going:
            bad = judged.where("verdict = 'conflict' OR statement IS NULL").first()
            if bad is not None:
                raise ValueError(f"table {bad.database}.{bad.table}: {'no statement' if bad.statement is None else 'its uuid is another table'}")
        tables = judged.where("verdict = 'keep' AND statement IS NOT NULL").drop("verdict")
        tables = reconcile.table_actions(tables, live).withColumn("rank", reconcile.restore_rank(F.col("engine")))
        mine = self.parts.where(F.col("backup") == self.resolve(name)).select("database", "table", "part", names.physical_name(F.col("link_part_name"), F.col("part")).alias("stored_as"), F.coalesce("link", "backup").alias("stored_in"))
        mine = reconcile.part_actions(mine, state, ["database", "table", "part"]).where("action <> 'skip'")
        fetch = mine.groupBy("database", "table").agg(F.array_sort(F.collect_list(F.struct("part", "action", "stored_in", "stored_as"))).alias("parts"))
        return tables.join(fetch, ["database", "table"], "left").orderBy("rank", *order)

    def cloud_metadata_paths(self, name: str, root: str, disks: list[str], compressed: bool = False, existing: DataFrame | None = None) -> DataFrame:
        """(disk, path) of the archives that hold a backup's object-storage metadata, one for each table.

        existing: (path) of what is stored; then only archives that are, and of a disk whose one old
        archive for all tables is stored, that one alone.
        """
        b = self.resolve(name)
        t = self.parts.where(F.col("backup") == b).select("database", "table").distinct()
        t = t.withColumn("disk", F.explode(F.array(*map(F.lit, disks)))) if disks else t.withColumn("disk", F.lit(None).cast("string")).limit(0)
        paths = t.select("disk", names.disk_table_path(root, F.lit(b), F.col("disk"), F.col("database"), F.col("table"), compressed).alias("path"))
        if existing is None:
            return paths
        old = t.select("disk").distinct().withColumn("path", names.legacy_disk_path(root, F.lit(b), F.col("disk"), compressed))
        there = lambda df: df.join(existing.select("path").distinct(), "path", "left_semi").select("disk", "path")
        return first_of(there(old), there(paths), ["disk"])


def bulk_deletes(paths: DataFrame, size: int = DELETE_BATCH) -> DataFrame:
    """(path) dealt into numbered batches."""
    return batches(paths.withColumn("_key", F.xxhash64("path")), "_key", ["path"], size).drop("_key")
