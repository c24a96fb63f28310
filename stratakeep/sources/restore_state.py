"""The state of a restore as a document, so that a later try goes on where the last one ended.

The document is {"databases": {database: {table: {part: state}}}, "failed": {database: {table:
{"failed_paths": [...], "failed_parts": {part: error}}}}}. It is kept as lines, each a document of
some parts of one table; all lines together are the whole. Versions are folders that Spark commits;
the state is the last committed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakeep.sources.shared import path_of, stored
from stratakeep.streaming.polls import PROGRESS

_STATES = "map<string,map<string,map<string,string>>>"
_FAILED = "map<string,map<string,struct<failed_paths:array<string>,failed_parts:map<string,string>>>>"
SCHEMA = f"struct<databases:{_STATES},failed:{_FAILED}>"
PARTS = "database string, table string, part string, state string"
FAILURES = "database string, table string, part string, path string, error string"
#: Entries of one line at most, about.
LINE = 50_000

_TABLE = ["database", "table"]


def _dealt(rows: DataFrame, line: int) -> DataFrame:
    """rows with the number of the line of their table that they are in."""
    lines = rows.groupBy(*_TABLE).agg(F.ceil(F.count(F.lit(1)) / line).alias("_lines"))
    return rows.join(lines, _TABLE).withColumn("_line", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in _TABLE]), F.col("_lines")))


def to_documents(parts: DataFrame, failures: DataFrame | None = None, line: int = LINE) -> DataFrame:
    """(document): lines that together hold parts (database, table, part, state) and failures (database, table, part, path, error).

    A failure of a part has its error, one of a path (its owner couldn't be changed) has the path.
    Repeated parts keep the furthest state, repeated failures count once; rows without a database or
    table are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, PROGRESS)), F.col("state"))
    known = parts.where("database is not null and `table` is not null and part is not null").groupBy(*_TABLE, "part").agg(F.max_by("state", rank).alias("state"))
    states = _dealt(known, line).groupBy(*_TABLE, "_line").agg(F.map_from_entries(F.collect_list(F.struct("part", "state"))).alias("m"))
    nested = lambda value: F.create_map("database", F.create_map("table", value))
    out = states.select(F.to_json(F.struct(nested(F.col("m")).alias("databases"), F.create_map().cast(_FAILED).alias("failed"))).alias("document"))
    if failures is None:
        return out
    failed = failures.where("database is not null and `table` is not null").groupBy(*_TABLE, "part", "path").agg(F.max("error").alias("error"))
    bad = _dealt(failed, line).groupBy(*_TABLE, "_line").agg(
        F.collect_list(F.when(F.col("part").isNull(), F.col("path"))).alias("paths"), F.map_from_entries(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", F.coalesce("error", F.lit("")))))).alias("errors")
    )
    entry = F.struct(F.col("paths").alias("failed_paths"), F.col("errors").alias("failed_parts"))
    return out.unionByName(bad.select(F.to_json(F.struct(F.create_map().cast(_STATES).alias("databases"), nested(entry).alias("failed"))).alias("document")))


def parts_of(documents: DataFrame) -> DataFrame:
    """(database, table, part, state) of documents (document): what a restore goes on from."""
    d = documents.select(F.from_json("document", SCHEMA).alias("d")).select(F.explode("d.databases").alias("database", "t"))
    return d.select("database", F.explode("t").alias("table", "p")).select("database", "table", F.explode("p").alias("part", "state"))


def failures_of(documents: DataFrame) -> DataFrame:
    """(database, table, part, path, error) of documents: for a report; a restore doesn't go on from them."""
    d = documents.select(F.from_json("document", SCHEMA).alias("d")).select(F.explode("d.failed").alias("database", "t")).select("database", F.explode("t").alias("table", "f"))
    none = F.lit(None).cast("string")
    paths = d.select("database", "table", none.alias("part"), F.explode("f.failed_paths").alias("path"), none.alias("error"))
    return paths.unionByName(d.select("database", "table", F.explode("f.failed_parts").alias("part", "error")).withColumn("path", none))


def any_failed(failures: DataFrame) -> bool:
    """Whether a part failed; a path whose owner couldn't be changed isn't a failed part."""
    return not failures.where("part is not null").isEmpty()


class RestoreState:
    """The state document in a folder, as a sink of micro-batches of updates.

    update(batch, number) may be the function of a foreachBatch: a version is made from the last
    one with a smaller number, so a batch that comes again, after a crash before or after its
    commit, changes nothing. Failures of earlier tries aren't taken over: what this object has not
    written itself is left out of the next version.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2, line: int = LINE):
        self.spark, self.folder, self.keep, self.line, self.written = spark, folder.rstrip("/"), keep, line, set()

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        files, root = path_of(self.spark, self.folder)
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return sorted(n for n in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(n)}/_SUCCESS")))

    def _at(self, number: int) -> str:
        return f"{self.folder}/version={number:012d}"

    def documents(self, number: int | None = None) -> DataFrame:
        """(document) of a version, by default the last; none before the first."""
        found = self.versions()
        number = found[-1] if number is None and found else number
        if number is None:
            return self.spark.createDataFrame([], "document string")
        return self.spark.read.schema("value string").text(self._at(number)).withColumnRenamed("value", "document")

    def parts(self) -> DataFrame:
        return parts_of(self.documents())

    def failures(self) -> DataFrame:
        return failures_of(self.documents())

    def update(self, batch: DataFrame, number: int) -> None:
        """Take in updates (database, table, part, path, seconds, state, error).

        A row with a state sets a part's; of one batch's the last by seconds counts, of one time the
        furthest. A row with an error adds a failed part, one with a path a failed path.
        """
        before = [n for n in self.versions() if n < number]
        old = self.documents(before[-1]) if before else self.documents().limit(0)
        batch = stored(batch, "restore-updates")
        rank = F.array_position(F.array(*map(F.lit, PROGRESS)), F.col("state"))
        new = batch.where("state is not null").select(*_TABLE, "part", F.struct(F.lit(1).alias("new"), F.col("seconds").cast("double").alias("at"), rank.alias("rank"), "state").alias("s"))
        was = parts_of(old).select(*_TABLE, "part", F.struct(F.lit(0).alias("new"), F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("rank"), "state").alias("s"))
        parts = was.unionByName(new).groupBy(*_TABLE, "part").agg(F.max("s")["state"].alias("state"))
        failed = batch.where("error is not null or path is not null").select(*_TABLE, F.when(F.col("path").isNull(), F.col("part")).alias("part"), "path", "error")
        if before and before[-1] in self.written:
            failed = failures_of(old).join(failed.where("part is not null").select(*_TABLE, "part").distinct(), [*_TABLE, "part"], "left_anti").unionByName(failed)
        to_documents(parts, failed, self.line).withColumnRenamed("document", "value").write.mode("overwrite").text(self._at(number))
        self.written.add(number)
        for n in self.versions()[: -self.keep]:
            files, path = path_of(self.spark, self._at(n))
            files.delete(path, True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        return self.update
