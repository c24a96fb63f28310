"""Which replicas' nodes a coordination tree still holds for tables and databases that are to be restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.functions.ddl import coordination_path, replicated_database
from stratakeep.functions.text import absolute_path, macro_names, replace_from

_REPLICA = r"\A(.*)/replicas/([^/]+)\z"


def _resolved(rows: DataFrame, key: list[str], text: str, macros: DataFrame, own: dict[str, Column], out: str) -> DataFrame:
    """rows with column `text` as `out`, its macros replaced: a row's own, or else those of the table (macro, substitution).

    Only macros that a text names are joined, on their names.
    """
    mine = F.create_map(*[x for name, value in own.items() for x in (F.lit(name), value.cast("string"))])
    mine = F.map_filter(mine, lambda _, v: v.isNotNull())
    asked = rows.select(*key, F.explode(macro_names(F.col(text))).alias("macro")).join(macros.groupBy("macro").agg(F.max("substitution").alias("substitution")), "macro")
    given = asked.where("substitution is not null").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("macro", "substitution"))).alias("_given"))
    joined = rows.join(given, key, "left")
    none = F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce("_given", none), lambda k, _: ~F.map_contains_key(mine, k))
    return joined.withColumn(out, replace_from(F.col(text), F.map_concat(mine, rest))).drop("_given")


def _there(tree: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """((path, replica, node), (node)): replicas that a tree (path) holds, with paths below root; and its nodes."""
    nodes = tree.select(F.col("path").alias("node")).distinct()
    top = absolute_path(F.lit(root or "/"))
    full = F.regexp_extract("node", _REPLICA, 1)
    inside = F.when(top == "/", full).when(F.startswith(full, F.concat(top, F.lit("/"))), F.substring(full, F.length(top) + 1, F.length(full)))
    found = nodes.where(F.col("node").rlike(_REPLICA)).select(inside.alias("path"), F.regexp_extract("node", _REPLICA, 2).alias("replica"), "node")
    return found.where("path is not null and path <> ''"), nodes


def _plan(wanted: DataFrame, tree: DataFrame, root: str, keep: list[str], flag: str, action: str, override: Column | None) -> DataFrame:
    there, nodes = _there(tree, root)
    found = wanted.join(there, "path")
    if override is not None:
        found = found.where(F.col("replica") == override)
    flags = nodes.where(F.endswith("node", F.lit(f"/{flag}"))).select(F.regexp_replace("node", rf"/{flag}\z", "").alias("node"), F.lit(True).alias("_flag"))
    both = found.join(flags, "node", "left")
    steps = F.array_compact(F.array(
        F.when(F.col("_flag"), F.struct(F.lit(0).alias("step"), F.lit("delete_node").alias("action"), F.concat("node", F.lit(f"/{flag}")).alias("node"))),
        F.struct(F.lit(1).alias("step"), F.lit(action).alias("action"), F.col("node").alias("node")),
    ))
    return both.select(*keep, F.col("replica").alias("name"), "path", F.explode(steps).alias("s")).select(*keep, "name", "path", "s.step", "s.action", "s.node")


def clean_tables(tables: DataFrame, macros: DataFrame, tree: DataFrame, root: str = "", replica: str | None = None) -> DataFrame:
    """(database, table, name, path, step, action, node): what frees the coordination paths of replicated tables.

    tables: (database, table, uuid, statement); macros: (macro, substitution), over which database,
    table and uuid of the row go; tree: (path) of the nodes there are, below root. Of each replica's
    node (of that named `replica` alone, if given) its `is_active` flag is deleted, step 0, then it
    is dropped, step 1; `name` and `path` are what the statement of plans.actions takes. Tables that
    aren't replicated, or have no node, have no rows. Repeated tables count once.
    """
    rows = tables.where("database is not null and `table` is not null").groupBy("database", "table").agg(F.max(F.struct("statement", "uuid")).alias("t"))
    rows = rows.select("database", "table", F.col("t.uuid").alias("uuid"), coordination_path(F.col("t.statement")).alias("_text")).where("_text is not null")
    own = {"database": F.col("database"), "table": F.col("table"), "uuid": F.col("uuid")}
    wanted = _resolved(rows, ["database", "table"], "_text", macros, own, "_path").withColumn("path", absolute_path(F.col("_path")))
    return _plan(wanted, tree, root, ["database", "table"], "is_active", "drop_replica", None if replica is None else F.lit(replica))


def clean_databases(databases: DataFrame, macros: DataFrame, tree: DataFrame, root: str = "", replica: str | None = None) -> DataFrame:
    """(database, name, path, step, action, node): the same for replicated databases (database, uuid, engine_full).

    A database's replicas are named shard|replica; the flag is `active`. Other engines have no rows.
    """
    rows = databases.where("database is not null").groupBy("database").agg(F.max(F.struct("engine_full", "uuid")).alias("d"))
    engine = replicated_database(F.col("d.engine_full"))
    rows = rows.select("database", F.col("d.uuid").alias("uuid"), engine["path"].alias("_text"), engine["shard"].alias("_shard")).where("_text is not null")
    own = {"database": F.col("database"), "uuid": F.col("uuid")}
    wanted = _resolved(rows, ["database"], "_text", macros, own, "_path").withColumn("path", absolute_path(F.col("_path")))
    wanted = _resolved(wanted, ["database"], "_shard", macros, own, "_own_shard")
    override = None if replica is None else F.concat(F.col("_own_shard"), F.lit(f"|{replica}"))
    return _plan(wanted, tree, root, ["database"], "active", "drop_database_replica", override)


def after_errors(plan: DataFrame, errors: DataFrame) -> DataFrame:
    """Dropped replicas of a plan that failed (errors: node, message), with what is to be done: `next`.

    delete_tree: a local table is still there, so the node goes with all below it; ignore: the path
    isn't one of a table or database; raise: anything else.
    """
    failed = plan.where("step = 1").join(errors.groupBy("node").agg(F.max("message").alias("message")), "node")
    m, table = F.col("message"), F.col("action") == "drop_replica"
    held = table & (F.contains(m, F.lit("TABLE_WAS_NOT_DROPPED")) | F.contains(m, F.lit("There is a local table")))
    other = F.when(table, F.contains(m, F.lit("does not look like a table path"))).otherwise(F.contains(m, F.lit("does not look like a path of Replicated database")) | F.contains(m, F.lit("node doesn't exist")))
    return failed.withColumn("next", F.when(held, "delete_tree").when(other, "ignore").otherwise("raise"))
