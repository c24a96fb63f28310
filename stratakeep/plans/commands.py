"""Whole plans of a backup and of a restore: what is checked first, what takes part, and every action in order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.functions import names as nm
from stratakeep.operators import dependencies, reconcile, selection, totals
from stratakeep.plans.catalog import Catalog
from stratakeep.sources.shared import stored

#: What a backup or restore may be of.
SOURCES = ("access", "data", "schema", "udf", "named_collections", "workload_entities")


@dataclass
class NewBackup:
    """meta: one row, the metadata a backup begins with; parts: what is to be done with each part; skipped: the backup that makes it needless, if any."""

    meta: DataFrame | None
    parts: DataFrame | None
    sources: frozenset[str]
    skipped: str | None = None


def chosen_sources(given: set[str] | None, schema_only: bool, for_restore: bool = False) -> frozenset[str]:
    """Which sources take part if those of `given` were asked for (none: the usual ones)."""
    if unknown := set(given or ()) - set(SOURCES):
        raise ValueError(f"no such sources: {', '.join(sorted(unknown))}")
    if given:
        return frozenset(given) | ({"schema"} if "data" in given else frozenset())
    usual = set(SOURCES) - ({"access"} if for_restore else set()) - ({"data"} if schema_only else set())
    return frozenset(usual)


def new_backup(
    catalog: Catalog, name: str, current: DataFrame, hostname: str, now: datetime, *, disks: DataFrame | None = None, databases: list[str] | None = None, tables: list[str] | None = None,
    exclude: list[str] | None = None, sources: set[str] | None = None, schema_only: bool = False, labels: dict[str, str] | None = None, usual_labels: dict[str, str] | None = None,
    min_interval: int = 0, force: bool = False, since: datetime | str | None = None, dedup: bool = True, valid: DataFrame | None = None,
) -> NewBackup:
    """The plan of a backup `name` of current parts (database, table, part, checksum, bytes, disk_name).

    The name must be of letters, digits, _ and -, and new. If the newest backup, of any state, ended
    less than min_interval seconds before now, it stands for this one, unless forced. databases or
    tables ("database.table") choose, exclude leaves databases out; none chosen is all. Labels go
    over the usual ones. disks: (disk, type, object_storage_type); parts on one of object storage
    are kept where they are, neither linked nor uploaded. Without the source data there are no parts.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"{name!r} isn't a name of letters, digits, _ and -")
    if databases is not None and tables is not None:
        raise ValueError("databases or tables, not both")
    if not catalog.backups.where(F.col("name") == name).isEmpty():
        raise ValueError(f"there is a backup {name} already")
    parts_of = chosen_sources(sources, schema_only)
    if min_interval and not force:
        gate = totals.interval_gate(catalog.backups.withColumn("_all", F.lit(1)), now, min_interval, ["_all"]).first()
        if gate is not None and not gate.allowed:
            return NewBackup(None, None, parts_of, skipped=gate.newest)
    spark = catalog.backups.sparkSession
    meta = spark.createDataFrame(
        [(name, hostname, "creating", {**(usual_labels or {}), **(labels or {})}, now, "data" not in parts_of)], "name string, hostname string, state string, labels map<string,string>, start_time timestamp_ntz, schema_only boolean"
    )
    wanted = selection.without_databases(current, exclude or [])
    wanted = selection.only(wanted, databases, "database")
    wanted = wanted if tables is None else selection.chosen_tables(wanted, tables)
    if "data" not in parts_of:
        wanted = wanted.limit(0)
    kept = wanted.limit(0)
    if disks is not None:
        kind = reconcile.disk_type(F.col("type"), F.col("object_storage_type"))
        elsewhere = disks.where(kind == "s3").select(F.col("disk").alias("disk_name")).distinct()
        kept, wanted = wanted.join(elsewhere, "disk_name", "left_semi"), wanted.join(elsewhere, "disk_name", "left_anti")
    plan = catalog.plan_backup(wanted, hostname, since, dedup, valid)
    plan = plan.select("database", "table", "part", "action", "link", "link_part_name", "bytes", "chunk", "multipart")
    stay = kept.select("database", "table", "part", F.lit("keep").alias("action"), "bytes")
    return NewBackup(meta, plan.unionByName(stay, allowMissingColumns=True), parts_of)


def _or_fail(bad: DataFrame, keep_going: bool, what: str) -> None:
    """An error that names up to ten of the objects, unless what fails is left out."""
    if not keep_going and (rows := bad.limit(11).collect()):
        raise ValueError(f"{what}: {', '.join(sorted('.'.join(r) for r in rows)[:10])}{' ...' if len(rows) > 10 else ''}")


@dataclass(frozen=True)
class Choice:
    """What a restore is of. databases: None is all, otherwise each must be stored; include and exclude: patterns "database.glob"."""

    databases: list[str] | None = None
    exclude_databases: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    sources: frozenset[str] | None = None
    schema_only: bool = False
    keep_going: bool = False

    def takes(self, database: Column, table: Column) -> Column:
        return selection.combined(database, table, list(self.include), list(self.exclude))


_ACTIONS = {"phase": "int", "round": "long", "rank": "int", "kind": "string", "database": "string", "table": "string", "part": "string", "action": "string", "stored_in": "string", "stored_as": "string", "reason": "string"}


def _rows(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*[(values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in _ACTIONS.items()])


def restore(catalog: Catalog, name: str, databases: DataFrame, tables: DataFrame, live_databases: DataFrame, live: DataFrame, state: DataFrame, choice: Choice = Choice(), required: DataFrame | None = None, failing: DataFrame | None = None) -> DataFrame:
    """(phase, round, rank, kind, database, table, part, action, stored_in, stored_as, reason): a restore of a backup, to be done in this order.

    databases: (database, engine) and tables: (database, table, engine, uuid, statement), as stored;
    live_databases and live: the same of the server; state: (database, table, part, state) of earlier
    tries; required: (database, table) that must be among what is restored; failing: tables (database,
    table) known to fail. Phase 0 creates, recreates or skips databases. Phase 1 does so with tables:
    in rounds, a table after all that its statement needs, and in a round by rank: merge trees,
    others, distributed tables, views. Phase 2 fetches or attaches the parts of tables that are
    restored, those already restored aside. Without the source data there is no phase 2.

    A database of the choice that isn't stored is an error. So are, unless the choice says to keep
    going, required tables that aren't there, tables without a statement or whose uuid is another
    table's, and tables that can't be restored for what they need; when it goes on, these are rows
    of action `fail` in the last phase, with the reason. A table that is stored twice by one name is
    restored once.
    """
    name = catalog.resolve(name)
    have = databases.select("database").distinct()
    if choice.databases is not None:
        asked = databases.sparkSession.createDataFrame([(d,) for d in choice.databases], "database string")
        _or_fail(asked.join(have, "database", "left_anti"), False, f"not in {name}")
    picked = selection.only(databases, choice.databases, "database")
    picked = selection.without_databases(picked, list(choice.exclude_databases)).select("database", "engine").distinct()
    mine = tables.join(picked.select("database"), "database", "left_semi").where(choice.takes(F.col("database"), F.col("table")))
    key = ["database", "table"]
    lost = mine.select(*key).limit(0).withColumn("reason", F.lit(""))
    if required is not None:
        absent = reconcile.missing(required.select(*key).distinct(), mine, key)
        _or_fail(absent, choice.keep_going, "required tables aren't stored")
        lost = lost.unionByName(absent.withColumn("reason", F.lit("absent")))
    judged = stored(reconcile.first_of_uuid(mine, key), "judged")
    conflict, wordless = judged.where("verdict = 'conflict'"), judged.where("verdict = 'keep' and statement is null")
    _or_fail(conflict.select(*key), choice.keep_going, "the uuid is another table's")
    _or_fail(wordless.select(*key), choice.keep_going, "no statement")
    for df, reason in ((conflict, "conflict"), (wordless, "no statement")):
        lost = lost.unionByName(df.select(*key).distinct().withColumn("reason", F.lit(reason)))
    good = judged.where("verdict = 'keep' and statement is not null").drop("verdict")
    good = good.groupBy(*key).agg(F.max(F.struct("statement", "engine", "uuid")).alias("t")).select(*key, "t.engine", "t.uuid", "t.statement")
    acted = stored(reconcile.table_actions(good, live), "acted")
    # what is live and stays so needs no waiting for
    staying = live.select(*key).join(acted.where("action <> 'skip'").select(*key), key, "left_anti")
    rounds = dependencies.restore_rounds(acted, dependencies.dependencies(acted), staying, failing)
    placed = stored(acted.join(rounds, key), "placed")
    stuck = placed.where("round is null")
    _or_fail(stuck.select(*key), choice.keep_going, "these can't be restored, for what they need")
    lost = lost.unionByName(stuck.select(*key, "reason"))
    done = placed.where("round is not null")

    first = reconcile.reconcile(picked, live_databases.groupBy("database").agg(F.max("engine").alias("engine")), ["database"], "engine")
    out = _rows(first, phase=F.lit(0), kind=F.lit("database"), database=F.col("database"), action=F.col("action"))
    one = F.col("round"), reconcile.restore_rank(F.col("engine"))
    out = out.unionByName(_rows(done, phase=F.lit(1), round=one[0], rank=one[1], kind=F.lit("table"), database=F.col("database"), table=F.col("table"), action=F.col("action")))
    if "data" in chosen_sources(set(choice.sources or ()), choice.schema_only, for_restore=True):
        held = catalog.parts.where(F.col("backup") == name).join(done.select(*key), key, "left_semi")
        fetched = reconcile.part_actions(held.select(*key, "part", "link", "link_part_name"), state, [*key, "part"]).where("action <> 'skip'")
        as_stored = nm.physical_name(F.col("link_part_name"), F.col("part"))
        out = out.unionByName(_rows(fetched, phase=F.lit(2), kind=F.lit("part"), database=F.col("database"), table=F.col("table"), part=F.col("part"), action=F.col("action"), stored_in=F.coalesce("link", F.lit(name)), stored_as=as_stored))
    out = out.unionByName(_rows(lost, phase=F.lit(3), kind=F.lit("table"), database=F.col("database"), table=F.col("table"), action=F.lit("fail"), reason=F.col("reason")))
    return out.orderBy("phase", "round", "rank", "database", "table", "part")


def restore_entities(entities: DataFrame, live: DataFrame, collections: DataFrame, live_collections: DataFrame) -> DataFrame:
    """(phase, depth, step, kind, name, action, statement): workload entities and named collections, drops before what they make way for.

    entities: (name, type, parent, statement) of workloads and resources; live: (name, type,
    statement); collections and live_collections: (name, statement). Phase 0 is resources, phase 1
    workloads, parents first (those on a cycle last), phase 2 collections. What is the same on the
    server has no row; what differs is dropped, step 0, and created, step 1. A name that is live as
    another type is an error, as is a parent that isn't among the workloads.
    """
    from stratakeep.operators.workloads import depths

    judged = reconcile.workload_actions(entities, live)
    if (bad := judged.where("action = 'error'").first()) is not None:
        raise ValueError(f"{bad.name} is a {bad.type} in the backup and something else on the server")
    placed = depths(entities.where("type = 'workload'").select("name", "parent")).select("name", F.when(F.col("depth") < 0, F.lit(1 << 30)).otherwise(F.col("depth")).alias("depth"))
    placed = judged.join(placed.withColumn("type", F.lit("workload")), ["name", "type"], "left")
    phase = F.when(F.col("type") == "resource", 0).otherwise(1)
    both = placed.select(phase.alias("phase"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("type").alias("kind"), "name", "action", "statement")
    named = reconcile.reconcile(collections.select("name", "statement"), live_collections, ["name"], "statement")
    both = both.unionByName(named.select(F.lit(2).alias("phase"), F.lit(0).cast("long").alias("depth"), F.lit("named_collection").alias("kind"), "name", "action", "statement"))
    steps = F.when(F.col("action") == "recreate", F.array(F.lit("drop"), F.lit("create"))).when(F.col("action") == "create", F.array(F.lit("create"))).otherwise(F.array().cast("array<string>"))
    each = both.withColumn("s", F.explode(steps)).withColumn("step", F.when(F.col("s") == "drop", 0).otherwise(1))
    act = F.when(F.col("s") == "drop", F.concat(F.lit("drop_"), "kind")).otherwise(F.concat(F.lit("create_"), "kind"))
    return each.select("phase", "depth", "step", "kind", "name", act.alias("action"), F.when(F.col("step") == 1, F.col("statement")).alias("statement")).orderBy("phase", "depth", "name", "step")
