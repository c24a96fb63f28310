"""What must be done to objects on a server so that they match what is stored: actions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakeep.functions.ddl import same_schema, strip_except_id

#: Engines that work on data elsewhere.
EXTERNAL_ENGINES = (
    "COSN", "ExternalDistributed", "HDFS", "Hive", "JDBC", "Kafka", "MeiliSearch", "MongoDB", "MySQL", "ODBC", "PostgreSQL",
    "MaterializedPostgreSQL", "RabbitMQ", "S3", "URL", "AzureBlobStorage", "AzureQueue", "DeltaLake", "Hudi", "NATS", "Redis", "SQLite",
)
EXTERNAL_DATABASE_ENGINES = ("MySQL", "MaterializedMySQL", "PostgreSQL", "MaterializedPostgreSQL")
EMBEDDED_DATABASES = ("default", "system", "_temporary_and_external_tables", "information_schema", "INFORMATION_SCHEMA")
VIEWS = ("View", "LiveView", "MaterializedView")


def engine_flags(engine: Column) -> dict[str, Column]:
    merge_tree = F.contains(engine, F.lit("MergeTree"))
    return {
        "is_merge_tree": merge_tree,
        "is_replicated": merge_tree & F.contains(engine, F.lit("Replicated")),
        "is_view": engine.isin(*VIEWS),
        "is_distributed": engine == "Distributed",
        "is_materialized_view": engine == "MaterializedView",
        "is_external": engine.isin(*EXTERNAL_ENGINES) | F.startswith(engine, F.lit("Iceberg")),
        "is_dictionary": engine == "Dictionary",
    }


def database_flags(name: Column, engine: Column) -> dict[str, Column]:
    return {
        "is_atomic": engine.isin("Atomic", "Replicated"),
        "is_replicated": engine == "Replicated",
        "is_external": engine.isin(*EXTERNAL_DATABASE_ENGINES),
        "is_embedded": name.isin(*EMBEDDED_DATABASES),
    }


def disk_type(kind: Column, object_storage: Column) -> Column:
    return F.when(kind == "ObjectStorage", F.lower(object_storage)).otherwise(F.lower(kind))


def restore_rank(engine: Column) -> Column:
    """Order of restoring: merge trees, others, distributed, views."""
    f = engine_flags(engine)
    return F.when(f["is_merge_tree"], 0).when(f["is_distributed"], 2).when(f["is_view"], 3).otherwise(1)


def reconcile(stored: DataFrame, live: DataFrame, key: list[str], same: str) -> DataFrame:
    """stored with action: create what isn't live, recreate what differs in column `same`, skip the rest."""
    there = live.select(*key, F.col(same).alias("_live"), F.lit(True).alias("_there"))
    out = stored.join(there, key, "left")
    action = F.when(F.col("_there").isNull(), "create").when(F.col(same).eqNullSafe(F.col("_live")), "skip").otherwise("recreate")
    return out.withColumn("action", action).drop("_live", "_there")


def match_two_ways(wanted: DataFrame, existing: DataFrame, first: list[str], second: list[str], value: str) -> DataFrame:
    """wanted with `value` of the existing row found by `first`, or else by `second`.

    Where existing repeats a key, the row with the greatest value stands for it.
    """
    by = lambda key, name: existing.where(" and ".join(f"`{c}` is not null" for c in key)).groupBy(*key).agg(F.max(value).alias(name))
    out = wanted.join(by(first, "_a"), first, "left").join(by(second, "_b"), second, "left")
    return out.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def table_actions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (database, table, uuid, statement) with action: skip, recreate or create.

    A table of the same name is compared by its schema; else one of the same uuid is dropped.
    """
    by_name = existing.groupBy("database", "table").agg(F.max("statement").alias("_statement"))
    by_uuid = existing.where("uuid is not null").select("uuid").distinct().withColumn("_other", F.lit(True))
    out = wanted.join(by_name, ["database", "table"], "left").join(by_uuid, "uuid", "left")
    action = F.when(F.col("_statement").isNotNull(), F.when(same_schema(F.col("_statement"), F.col("statement")), "skip").otherwise("recreate")).when(F.col("_other"), "recreate").otherwise("create")
    return out.withColumn("action", action).drop("_statement", "_other")


def first_of_uuid(tables: DataFrame, order: list[str]) -> DataFrame:
    """tables (database, table, uuid, ...) with verdict: keep, duplicate (same name as the first) or conflict.

    Of rows that tie in `order` the least name is the first. Tables without a uuid are kept and not
    shuffled; the first of a uuid comes from an aggregate, so a uuid that very many share is no
    window of its own: only rows alike in order and name meet in one.
    """
    blank = F.col("uuid").isNull() | (F.col("uuid").cast("string") == "")
    place = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col("database").alias("d"), F.col("table").alias("t"))
    named = tables.where(~blank)
    first = named.groupBy("uuid").agg(F.min(place).alias("_first"))
    alike = Window.partitionBy("uuid", *dict.fromkeys([*order, "database", "table"])).orderBy(F.lit(1))
    once = F.row_number().over(alike) == 1
    out = named.join(first, "uuid")
    same_name = F.col("database").eqNullSafe(F.col("_first.d")) & F.col("table").eqNullSafe(F.col("_first.t"))
    verdict = F.when(place.eqNullSafe(F.col("_first")) & once, "keep").when(same_name, "duplicate").otherwise("conflict")
    return tables.where(blank).withColumn("verdict", F.lit("keep")).unionByName(out.withColumn("verdict", verdict).select(*[F.col(f"`{c}`") for c in tables.columns], "verdict"))


def workload_actions(stored: DataFrame, live: DataFrame) -> DataFrame:
    """stored (name, type, statement) with action: create, skip, recreate, or error for another type of that name."""
    there = live.select("name", F.col("type").alias("_type"), F.col("statement").alias("_statement"))
    out = stored.join(there, "name", "left")
    action = F.when(F.col("_type").isNull(), "create").when(F.col("_type") != F.col("type"), "error").when(F.col("_statement") == F.col("statement"), "skip").otherwise("recreate")
    return out.withColumn("action", action).drop("_type", "_statement")


def duplicate_admins(users: DataFrame, linked: DataFrame) -> DataFrame:
    """Other ids of an admin (id, name, statement), with verdict: delete if alike but for its own id, else differs.

    linked: (name, id) of the one in use.
    """
    main = users.join(linked.select("name", F.col("id").alias("_id")), "name").where("id = _id").select("name", "_id", F.col("statement").alias("_main"))
    others = users.join(main, "name").where("id != _id")
    same = strip_except_id(F.col("statement")) == strip_except_id(F.col("_main"))
    return others.select("name", "id", F.when(same, "delete").otherwise("differs").alias("verdict"))


def part_actions(parts: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """parts with action by the restore state of earlier tries: skip, attach or download."""
    out = parts.join(state.select(*key, F.col("state").alias("_state")), key, "left")
    return out.withColumn("action", F.when(F.col("_state") == "restored", "skip").when(F.col("_state") == "downloaded", "attach").otherwise("download")).drop("_state")


def longest_prefix(paths: DataFrame, disks: DataFrame, path: str, key: list[str]) -> DataFrame:
    """paths with the disk whose path is the longest prefix; null where none is.

    Every prefix of a path that ends where some disk's path may is a candidate, so the join is on
    equality: paths are cut at each length that a disk path has.
    """
    lengths = [r.n for r in disks.select(F.length("disk_path").alias("n")).distinct().limit(10_001).collect()]
    if len(lengths) > 10_000:
        raise ValueError("disk paths of more than 10000 lengths")
    if not lengths:
        return paths.withColumn("disk", F.lit(None).cast("string"))
    cuts = F.array(*map(F.lit, sorted(lengths)))
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length(path)), lambda n: F.substring(F.col(path), F.lit(1), n))
    hits = paths.select(*key, F.explode(prefixes).alias("disk_path")).join(disks.select("disk", "disk_path"), "disk_path")
    best = hits.groupBy(*key).agg(F.max_by("disk", F.struct(F.length("disk_path"), "disk")).alias("disk"))
    return paths.join(best, key, "left")


def missing(required: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    return required.join(existing.select(*key).distinct(), key, "left_anti")


def with_statements(tables: DataFrame, statements: DataFrame, key: list[str]) -> DataFrame:
    """tables with their statement, null where it is missing; of several for one key the least counts."""
    return tables.join(statements.groupBy(*key).agg(F.min("statement").alias("statement")), key, "left")


def still_readonly(readonly: DataFrame, restored: DataFrame, fixed: DataFrame, key: list[str]) -> DataFrame:
    """Keys of restored tables whose replica is read-only and hasn't been fixed, each once."""
    return readonly.select(*key).distinct().join(restored.select(*key), key, "left_semi").join(fixed.select(*key), key, "left_anti")
