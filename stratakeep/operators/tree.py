"""A tree of nodes (path, value), as a log of what was done to it, and its last state.

Paths are `/a/b`; `/` is the root, which is always there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a log may hold. create and set give a node its value, and create makes the nodes above it
#: that aren't there, without a value; delete takes one node, delete_tree also all below it.
OPERATIONS = ("create", "set", "delete", "delete_tree")


def clean(path: Column) -> Column:
    """A path with one slash before each name and none at its end."""
    return F.concat(F.lit("/"), F.array_join(_names(path), "/"))


def _names(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def above(path: Column) -> Column:
    """The paths of a node's ancestors, the root first; the root has none."""
    names = _names(path)
    return F.when(F.size(names) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(names, 1, k), "/")))
    )


def replay(log: DataFrame) -> DataFrame:
    """(path, value, version) of the nodes that are there after a log (version, op, path, value).

    Versions order the log; of operations of one version deletions come first, and of two values the
    greater stays. version is that of the node's value, or of the creation below it that made it.
    Nodes that were made for one below have an empty value; a null value is empty too. Rows without
    a path or version are left out, an unknown op is an error, the root isn't listed. Nothing is
    sorted: each node's last value and last deletion are aggregates, and deletions of trees meet the
    nodes below them by the prefixes of paths, on equality.
    """
    op = F.when(F.col("op").isin(*OPERATIONS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such operation: "), F.coalesce("op", F.lit("null")))).cast("string"))
    rows = log.where("path is not null and version is not null").select(F.col("version").cast("long").alias("version"), op.alias("op"), clean(F.col("path")).alias("path"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    made = rows.where("op = 'create'").select("version", F.lit("made").alias("op"), F.explode(above(F.col("path"))).alias("path"), F.lit("").alias("value"))
    put, gone = F.col("op").isin("create", "set"), F.col("op").isin("delete", "delete_tree")
    nodes = rows.unionByName(made).where("path <> '/'").groupBy("path").agg(
        F.max(F.when(put, F.struct("version", "value"))).alias("put"), F.max(F.when(F.col("op") == "made", F.col("version"))).alias("made"), F.max(F.when(gone, F.col("version"))).alias("gone")
    )
    trees = rows.where("op = 'delete_tree'").groupBy(F.col("path").alias("top")).agg(F.max("version").alias("cut"))
    under = nodes.where("put is not null or made is not null").select("path", F.explode(above(F.col("path"))).alias("top"))
    cut = under.join(trees, "top").groupBy("path").agg(F.max("cut").alias("cut"))
    last = F.greatest("gone", "cut")
    since = lambda version: version.isNotNull() & (last.isNull() | (version >= last))
    kept = nodes.join(cut, "path", "left").select(
        "path", F.when(since(F.col("put.version")), F.col("put")).when(since(F.col("made")), F.struct(F.col("made").alias("version"), F.lit("").alias("value"))).alias("node")
    )
    return kept.where("node is not null").select("path", "node.value", "node.version")


def children(state: DataFrame, path: str) -> DataFrame:
    """(name, value) of the nodes right below a path."""
    top = "/" + "/".join(p for p in path.split("/") if p)
    start = top.rstrip("/") + "/"
    name = F.substring(F.col("path"), F.lit(len(start) + 1), F.length("path"))
    return state.where(F.col("path").startswith(start)).select(name.alias("name"), "value").where("name <> '' and not contains(name, '/')")


def as_log(state: DataFrame) -> DataFrame:
    """(version, op, path, value): a log that makes a state (path, value), before all versions from 1 on."""
    return state.select(F.lit(0).cast("long").alias("version"), F.lit("create").alias("op"), "path", "value")
