"""Access entities (users, roles, policies, quotas, profiles) over a tree of nodes: what is saved, what a restore does.

Below its root an access tree has `/uuid/<id>` with an entity's statement, and `/<char>/<name>` with
the id of the entity that a name of a kind means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.functions.ddl import strip_except_id
from stratakeep.functions.names import escape_file_name
from stratakeep.operators.prefix import running
from stratakeep.operators.tree import children, clean

#: Fixed value: the file that makes a server build its lists of entities anew.
REBUILD_MARK = "need_rebuild_lists.mark"


def _path(root: str, *names: Column | str) -> Column:
    return clean(F.concat_ws("/", F.lit(root), *[F.lit(n) if isinstance(n, str) else n for n in names]))


def save_access(entities: DataFrame, state: DataFrame, root: str, local: DataFrame | None = None) -> DataFrame:
    """(file, content) of a backup of entities (id): each one's statement in the tree; of `local` (file, content) what has none.

    An entity that is neither in the tree nor in local is an error.
    """
    ids = entities.select("id").where("id is not null").distinct().withColumn("file", F.concat("id", F.lit(".sql"))).withColumn("path", _path(root, "uuid", F.col("id")))
    found = ids.join(state.select("path", F.col("value").alias("content")), "path", "left")
    if local is not None:
        found = found.join(local.select("file", F.col("content").alias("_local")), "file", "left").withColumn("content", F.coalesce("content", "_local"))
    absent = F.raise_error(F.concat(F.lit("no statement of access entity "), F.col("id"))).cast("string")
    return found.select("file", F.coalesce("content", absent).alias("content"))


def restore_access(entities: DataFrame, state: DataFrame, root: str) -> DataFrame:
    """(position, step, op, path, value): what a restore does to a tree (path, value), in the order of position and step.

    entities: (position, id, name, char, statement) of a backup, positions from 0, none twice.
    Step 0 writes the entity's statement under its id. If its name means another id by then, in the
    tree or by an entity before it, step 1 deletes that one's node; step 2 lets the name mean the
    new id. A name that means the id already is left alone. Entities without a name or kind can't
    be put in a tree: nothing is done for them. Operations are those of operators.tree, so
    `as_versions` gives the log to replay on the state.
    """
    known = entities.where("id is not null and name is not null and char is not null")
    linked = known.withColumn("position", F.col("position").cast("long")).withColumn("link", _path(root, F.col("char"), escape_file_name(F.col("name"))))
    # a name may be given to very many ids one after the other: each is held against the one before it
    seen = running(linked, ["link"], "position", [], before=(F.max, F.struct("position", "id"), False))
    there = seen.join(state.select(F.col("path").alias("link"), F.col("value").alias("_there")), "link", "left")
    old = F.when(F.col("before").isNotNull(), F.col("before.id")).otherwise(F.col("_there"))
    moved = old.isNull() | (old != F.col("id"))
    step = lambda n, op, path, value: F.struct(F.lit(n).alias("step"), F.lit(op).alias("op"), path.alias("path"), value.cast("string").alias("value"))
    steps = F.array_compact(F.array(
        step(0, "create", _path(root, "uuid", F.col("id")), F.col("statement")),
        F.when(old.isNotNull() & moved, step(1, "delete", _path(root, "uuid", old), F.lit(None))),
        F.when(moved, step(2, "create", F.col("link"), F.col("id"))),
    ))
    return there.select("position", F.explode(steps).alias("s")).select("position", "s.step", "s.op", "s.path", "s.value")


def as_versions(plan: DataFrame, after: int = 0) -> DataFrame:
    """A plan (position, step, ...) as a log whose versions follow `after`."""
    return plan.select((F.col("position") * 3 + F.col("step") + F.lit(after + 1)).cast("long").alias("version"), "op", "path", "value")


def restore_local_access(entities: DataFrame, folder: str) -> DataFrame:
    """(step, op, path, value): the folder is emptied, each entity (id, statement) is a file in it, then the lists are marked.

    Without entities nothing is done.
    """
    files = entities.where("id is not null").groupBy("id").agg(F.max("statement").alias("value"))
    each = files.select(F.lit(1).alias("step"), F.lit("write_file").alias("op"), F.concat(F.lit(folder.rstrip("/") + "/"), "id", F.lit(".sql")).alias("path"), "value")
    around = files.groupBy().count().where("count > 0").select(F.explode(F.array(
        F.struct(F.lit(0).alias("step"), F.lit("clear_folder").alias("op"), F.lit(folder).alias("path"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit(2).alias("step"), F.lit("write_file").alias("op"), F.lit(f"{folder.rstrip('/')}/{REBUILD_MARK}").alias("path"), F.lit("").alias("value")),
    )).alias("s")).select("s.*")
    return each.unionByName(around)


def linked_id(state: DataFrame, root: str, name: str, char: str = "U") -> DataFrame:
    """(id) that a name means."""
    return children(state, f"{root}/{char}").where(F.col("name") == name).select(F.col("value").alias("id"))


def statements_of(state: DataFrame, root: str, name: str) -> DataFrame:
    """(id, statement) of all nodes that are a user of that name, whether the name means them or not."""
    return children(state, f"{root}/uuid").where(F.col("value").rlike(rf"\AATTACH USER (`?)\Q{name}\E\1(?=[\s;]|\z)")).select(F.col("name").alias("id"), F.col("value").alias("statement"))


def fix_user(state: DataFrame, root: str, folder: str, name: str = "admin") -> DataFrame:
    """(op, path): nodes and files of a user's other ids, which are the same but for their own id.

    The id that the name means must be among the user's nodes, and all others must be alike;
    otherwise it's an error. A name that means nothing is an error too.
    """
    link = linked_id(state, root, name).withColumn("_linked", F.lit(True))
    users = statements_of(state, root, name).join(link, "id", "left").withColumn("_clean", strip_except_id(F.col("statement")))
    main = users.where("_linked").select(F.col("_clean").alias("_main"))
    if (first := main.first()) is None:
        raise ValueError(f"the id that {name} means isn't among its nodes")
    judged = users.where("_linked is null").select("id", (F.col("_clean") == F.lit(first[0])).alias("same"))
    if (other := judged.where("not same").first()) is not None:
        raise ValueError(f"{other.id} of {name} differs from the one in use")
    node = F.struct(F.lit("delete").alias("op"), _path(root, "uuid", F.col("id")).alias("path"))
    file = F.struct(F.lit("delete_file").alias("op"), F.concat(F.lit(folder.rstrip("/") + "/"), "id", F.lit(".sql")).alias("path"))
    return judged.select(F.explode(F.array(node, file)).alias("s")).select("s.*")
