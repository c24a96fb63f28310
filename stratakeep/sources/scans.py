"""Scans of a server's system tables, whose columns and conditions depend on its version.

A scan gives the same columns for every version: what a version doesn't have is null. So results
of servers of different versions union by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.operators.selection import listed, without_databases

#: Databases that no scan shows, engines that stand for tables elsewhere, where access entities may be kept.
SYSTEM_DATABASES = ("system", "_temporary_and_external_tables", "information_schema", "INFORMATION_SCHEMA")
PROXIES = ("Proxy", "StorageProxy")
ACCESS_STORAGES = ("disk", "local directory", "local_directory", "replicated")
ACCESS_CHARS = {"users": "U", "roles": "R", "quotas": "Q", "row_policies": "P", "settings_profiles": "S"}
DETACHABLE = ("Atomic", "Ordinary", "Replicated", "Lazy")


def version_of(text: str) -> tuple[int, ...]:
    """The leading numbers of a version."""
    out = []
    for piece in text.split("."):
        if not piece.isdigit():
            break
        out.append(int(piece))
    return tuple(out)


@dataclass(frozen=True)
class Scan:
    """columns: name -> type of what the scan gives; since: of a column, or of "" for the whole scan, the first version that has it."""

    source: str
    columns: dict[str, str]
    since: dict[str, str] = field(default_factory=dict)
    only: Callable[[str], Column] | None = None
    order: Callable[[], list[Column]] | None = None

    def has(self, name: str, version: str) -> bool:
        return version_of(version) >= version_of(self.since.get(name, "0"))

    def __call__(self, server: dict[str, DataFrame], version: str) -> DataFrame:
        """The scan over a server's tables (by name); empty where its version has no such table."""
        frame = server.get(self.source)
        if frame is None or not self.has("", version):
            if self.has("", version):
                raise KeyError(f"a server of version {version} has a table {self.source}")
            return _empty(next(iter(server.values())), self.columns)
        rows = frame if self.only is None else frame.where(self.only(version))
        if self.order:
            rows = rows.orderBy(*self.order())
        return rows.select(*[(F.col(f"`{c}`") if self.has(c, version) else F.lit(None)).cast(t).alias(c) for c, t in self.columns.items()])


def _empty(any_frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return any_frame.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))


_TEXTS = dict.fromkeys
DISK = {"name": "string", "path": "string", "type": "string", "object_storage_type": "string", "metadata_type": "string", "cache_path": "string"}
_DISK_SINCE = {"cache_path": "22.8", "object_storage_type": "24.3", "metadata_type": "24.3"}

SCANS: dict[str, Scan] = {
    "disks": Scan("disks", DISK, _DISK_SINCE, order=lambda: [F.desc(F.length("path")), F.asc("name")]),
    "functions": Scan("functions", _TEXTS(("name", "create_query"), "string"), only=lambda _: F.col("origin") == "SQLUserDefined"),
    "named_collections": Scan("named_collections", {"name": "string"}, {"": "22.12"}),
    "macros": Scan("macros", _TEXTS(("macro", "substitution"), "string")),
    "databases": Scan("databases", _TEXTS(("name", "engine", "metadata_path", "uuid", "engine_full"), "string"), {"engine_full": "23.3"}, only=lambda _: ~F.col("name").isin(*SYSTEM_DATABASES)),
    "tables": Scan(
        "tables", {"database": "string", "name": "string", "engine": "string", "engine_full": "string", "create_table_query": "string", "data_paths": "array<string>", "metadata_path": "string", "uuid": "string", "metadata_modification_time": "timestamp_ntz"}
    ),
    "detached_tables": Scan("detached_tables", _TEXTS(("database", "table", "uuid", "metadata_path"), "string"), {"": "24.8"}),
    "replicas": Scan("replicas", {"database": "string", "table": "string", "is_readonly": "int"}, order=lambda: [F.asc("database"), F.asc("table")]),
    "ddl_queue": Scan("distributed_ddl_queue", {"entry": "string", "query": "string", "status": "string", "exception_code": "string", "exception_text": "string", "cluster": "string"}, only=lambda _: F.col("status") != "Finished", order=lambda: [F.asc("entry")]),
    "workloads": Scan("workloads", {"name": "string"}),
    "resources": Scan("resources", {"name": "string"}),
    **{kind: Scan(kind, _TEXTS(("id", "name"), "string"), only=lambda _: F.col("storage").isin(*ACCESS_STORAGES)) for kind in ACCESS_CHARS},
}


def databases(server: dict[str, DataFrame], version: str, system_database: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(name, engine, metadata_path, uuid, engine_full); engine_full is told of replicated databases alone."""
    found = SCANS["databases"](server, version)
    out = without_databases(found, [*(exclude or []), *([system_database] if system_database else [])], "name")
    return out.withColumn("engine_full", F.when(F.col("engine") == "Replicated", F.col("engine_full")))


def tables(server: dict[str, DataFrame], version: str, database: str | None = None, names: list[str] | None = None, short: bool = False) -> DataFrame:
    """Tables by the time their metadata changed, of one database and of some names if given (an empty list is no filter).

    Tables that stand for others elsewhere have no data paths: to ask for these would reach the
    other side. Servers before 24.3 do so for all tables of such a one's name. short leaves out
    what an external table's source would be asked for.
    """
    found = SCANS["tables"](server, version)
    if database is not None:
        found = found.where(F.col("database") == database)
    found = listed(found, names or [], "name")
    proxy = F.col("engine").isin(*PROXIES) if version_of(version) >= (24, 3) else F.col("engine") == "StorageProxy"
    if version_of(version) >= (24, 3):
        with_data = found.where(~proxy)
    else:
        with_data = found.join(found.where(proxy).select("name").distinct(), "name", "left_anti").select(*found.columns)
    out = with_data.unionByName(found.where(proxy).withColumn("data_paths", F.array().cast("array<string>")))
    if short:
        out = found.select("database", "name", "uuid", "engine", "create_table_query", "metadata_modification_time")
    return out.orderBy("metadata_modification_time", "database", "name")


def detached_tables(server: dict[str, DataFrame], version: str) -> DataFrame:
    """(database, table, uuid, metadata_path) in databases whose engine can detach tables; none before 24.8."""
    wanted = SCANS["databases"].__class__("databases", {"name": "string"}, only=lambda _: F.col("engine").isin(*DETACHABLE))(server, version)
    return SCANS["detached_tables"](server, version).join(wanted.withColumnRenamed("name", "database").distinct(), "database", "left_semi")


def replicas(server: dict[str, DataFrame], version: str, database: str | None = None, names: list[str] | None = None, readonly: bool | None = None) -> DataFrame:
    """(database, table, is_readonly), by database and table; each of the three conditions only if given."""
    found = SCANS["replicas"](server, version)
    if database is not None:
        found = found.where(F.col("database") == database)
    found = listed(found, names or [], "table")
    return found if readonly is None else found.where(F.col("is_readonly") == int(readonly))


def disk(server: dict[str, DataFrame], version: str, name: str) -> DataFrame:
    return SCANS["disks"](server, version).where(F.col("name") == name)


def ddl_errors(server: dict[str, DataFrame], version: str, cluster: str) -> DataFrame:
    """Unfinished entries of a cluster's queue whose code is a number other than 0."""
    return SCANS["ddl_queue"](server, version).where((F.col("cluster") == cluster) & (F.col("exception_code").try_cast("int") != 0))


def workload_entities(server: dict[str, DataFrame], version: str) -> DataFrame:
    """(name, type) of workloads and resources, by name."""
    kinds = [SCANS[scan](server, version).withColumn("type", F.lit(kind)) for scan, kind in (("workloads", "workload"), ("resources", "resource"))]
    return reduce(DataFrame.unionByName, kinds).orderBy("name", "type")


def access_entities(server: dict[str, DataFrame], version: str) -> DataFrame:
    """(id, name, char) of the five kinds of access entities."""
    return reduce(DataFrame.unionByName, [SCANS[kind](server, version).withColumn("char", F.lit(char)) for kind, char in ACCESS_CHARS.items()])


def of_servers(servers: list[tuple[str, str, dict[str, DataFrame]]], scan: Callable[..., DataFrame]) -> DataFrame:
    """One frame of a scan over several servers (host, version, tables), with their host."""
    return reduce(DataFrame.unionByName, [scan(tables_, version).withColumn("host", F.lit(host)) for host, version, tables_ in servers])


def running_freezes(processes: DataFrame, user: str) -> DataFrame:
    """Queries of a user (kind, user, query, query_id) that freeze a table, in any letter case."""
    return processes.where((F.col("query_kind") == "Alter") & (F.col("user") == user) & F.col("query").ilike("%ALTER TABLE%FREEZE%"))
