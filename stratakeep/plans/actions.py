"""Statements that carry out a plan's actions on a server, as text; running them is left to a client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.functions.names import backtick_escape


def _q(c: Column) -> Column:
    return F.concat(F.lit("`"), backtick_escape(c), F.lit("`"))


def _table() -> Column:
    return F.concat(_q(F.col("database")), F.lit("."), _q(F.col("table")))


def statement(action: Column) -> Column:
    """The statement of an action row (action, database, table, part, name, path); null for an unknown action."""
    name, path = _q(F.col("name")), F.concat(F.lit("'"), F.replace("path", F.lit("'"), F.lit("\\'")), F.lit("'"))
    database = _q(F.col("database"))
    text = {
        "attach_database": F.concat(F.lit("ATTACH DATABASE "), database),
        "attach_table": F.concat(F.lit("ATTACH TABLE "), _table()),
        "attach_part": F.concat(F.lit("ALTER TABLE "), _table(), F.lit(" ATTACH PART '"), F.col("part"), F.lit("'")),
        "freeze_table": F.concat(F.lit("ALTER TABLE "), _table(), F.lit(" FREEZE WITH NAME '"), F.col("name"), F.lit("'")),
        "freeze_partition": F.concat(F.lit("ALTER TABLE "), _table(), F.lit(" FREEZE PARTITION ID '"), F.col("part"), F.lit("' WITH NAME '"), F.col("name"), F.lit("'")),
        "unfreeze": F.concat(F.lit("SYSTEM UNFREEZE WITH NAME '"), F.col("name"), F.lit("'")),
        "drop_table": F.concat(F.lit("DROP TABLE IF EXISTS "), _table(), F.lit(" NO DELAY")),
        "drop_dictionary": F.concat(F.lit("DROP DICTIONARY IF EXISTS "), _table(), F.lit(" NO DELAY")),
        "drop_database": F.concat(F.lit("DROP DATABASE IF EXISTS "), database, F.lit(" NO DELAY")),
        "drop_function": F.concat(F.lit("DROP FUNCTION "), name),
        "drop_named_collection": F.concat(F.lit("DROP NAMED COLLECTION "), name),
        "drop_workload": F.concat(F.lit("DROP WORKLOAD "), name),
        "drop_resource": F.concat(F.lit("DROP RESOURCE "), name),
        "restore_replica": F.concat(F.lit("SYSTEM RESTORE REPLICA "), _table()),
        "drop_replica": F.concat(F.lit("SYSTEM DROP REPLICA '"), F.col("name"), F.lit("' FROM ZKPATH "), path),
        "drop_database_replica": F.concat(F.lit("SYSTEM DROP DATABASE REPLICA '"), F.col("name"), F.lit("' FROM ZKPATH "), path),
        "rename_table": F.concat(F.lit("RENAME TABLE "), _table(), F.lit(" TO "), database, F.lit("."), name),
        "reload_config": F.lit("SYSTEM RELOAD CONFIG"),
        "show_create_database": F.concat(F.lit("SHOW CREATE DATABASE "), database),
        "kill_freeze": F.concat(F.lit("KILL QUERY WHERE query_kind='Alter' AND user='"), F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("' AND query ILIKE '%ALTER TABLE%FREEZE%'")),
    }
    out = F.lit(None).cast("string")
    for kind, sql in text.items():
        out = F.when(action == kind, sql).otherwise(out)
    return out


def with_statements(actions: DataFrame) -> DataFrame:
    return actions.withColumn("statement", statement(F.col("action")))


def freezes(tables: DataFrame, parts: DataFrame, name: str, by_partition: bool = False) -> DataFrame:
    """(action, database, table, part, name): what freezes tables (database, table) under a backup's name, and unfreezes it at last.

    A table is frozen as a whole, or by_partition each of its partitions that has an active part
    (parts: database, table, partition_id, active); a table without one is then left out. Repeated
    tables count once.
    """
    once, key = tables.select("database", "table").where("database is not null and `table` is not null").distinct(), ["database", "table"]
    if by_partition:
        held = parts.where("active = 1").select(*key, F.col("partition_id").alias("part")).distinct()
        rows = once.join(held, key).select(F.lit("freeze_partition").alias("action"), *key, "part")
    else:
        rows = once.select(F.lit("freeze_table").alias("action"), *key, F.lit(None).cast("string").alias("part"))
    last = rows.sparkSession.createDataFrame([("unfreeze",)], "action string")
    return rows.unionByName(last, allowMissingColumns=True).withColumn("name", F.lit(name))
