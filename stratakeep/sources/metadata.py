"""Backup metadata documents: one JSON text a backup, read with a fixed schema and flattened."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakeep.functions.crypto import CHUNK, open_or_plain
from stratakeep.functions.text import parse_time
from stratakeep.sources.shared import path_of

_PART = "struct<checksum:string,bytes:bigint,files:array<string>,tarball:boolean,link:string,link_part_name:string,disk_name:string,encrypted:boolean>"
_TABLE = f"struct<engine:string,uuid:string,parts:map<string,{_PART}>>"
_DATABASE = f"struct<engine:string,metadata_path:string,uuid:string,engine_full:string,tables:map<string,{_TABLE}>>"
_META = (
    "struct<name:string,path:string,version:string,ch_version:string,hostname:string,labels:map<string,string>,time_format:string,start_time:string,end_time:string,"
    "bytes:bigint,real_bytes:bigint,state:string,exception:string,schema_only:boolean,encrypted:boolean,date_fmt:string,"
    "access_control:array<string>,access_controls:array<string>,user_defined_functions:array<string>,named_collections:array<string>>"
)
SCHEMA = f"struct<meta:{_META},databases:map<string,{_DATABASE}>,access_control:array<string>,access_controls:array<string>,user_defined_functions:array<string>,named_collections:array<string>,workload_entities:array<string>>"
DEFAULT_TIME_FORMAT = "%Y-%m-%d %H:%M:%S.%f %z"


def read_documents(spark: SparkSession, root: str, light: bool = False) -> DataFrame:
    """(backup, document) of every backup below root: of its own folder's document, or as write_documents leaves it."""
    root, name = root.rstrip("/"), "backup_light_struct.json" if light else "backup_struct.json"
    found = [df for df in (_texts(spark, root, f"*/{name}"), None if light else _texts(spark, root, "backup=*")) if df is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "backup string, document string")


def read_sealed_documents(spark: SparkSession, root: str, key: bytes, chunk: int = CHUNK) -> DataFrame:
    """(backup, document) like read_documents, of documents that are sealed by the backup's name or plain, each as it is.

    A sealed document that was changed, cut, or moved to another backup is an error when it is read.
    """
    files, path = path_of(spark, f"{root.rstrip('/')}/*/backup_struct.json")
    if not files.globStatus(path):
        return spark.createDataFrame([], "backup string, document string")
    read = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/backup_struct.json")
    named = read.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("backup"), "content")
    return named.select("backup", open_or_plain(F.col("content"), F.lit(key), chunk, F.col("backup")).cast("string").alias("document"))


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """(backup, document) of the files root/<backup>/name, or root/backup=<backup>/...; None if there are none."""
    files, path = path_of(spark, f"{root}/{name}")
    if not files.globStatus(path):
        return None
    if "=" in name:  # folders that Spark has named
        return spark.read.option("basePath", root).schema("value string, backup string").text(f"{root}/{name}").select("backup", F.col("value").alias("document"))
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return spark.read.text(f"{root}/{name}", wholetext=True).select(folder.alias("backup"), F.col("value").alias("document"))


def parse(documents: DataFrame) -> DataFrame:
    """(name, meta fields, databases) of (document); a document without name or state is an error.

    Lists may stand at the top or under meta, and access_controls is an old name of access_control.
    """
    d = documents.select(F.from_json("document", SCHEMA).alias("d"))
    listed = lambda *names: F.coalesce(*[F.col(f"d.{n}") for n in names], F.array().cast("array<string>"))
    m = "d.meta."
    fmt = F.coalesce(m + "time_format", m + "date_fmt", F.lit(DEFAULT_TIME_FORMAT))
    whole = F.col(m + "name").isNotNull() & F.col(m + "state").isNotNull()
    name = F.when(whole, F.col(m + "name")).otherwise(F.raise_error(F.lit("metadata document without name or state")).cast("string"))
    return d.select(
        name.alias("name"), F.col(m + "hostname"), F.col(m + "version"), F.col(m + "ch_version"), F.coalesce(m + "labels", F.create_map().cast("map<string,string>")).alias("labels"),
        parse_time(F.col(m + "start_time"), fmt).alias("start_time"), parse_time(F.col(m + "end_time"), fmt).alias("end_time"),
        F.coalesce(m + "bytes", F.lit(0)).alias("bytes"), F.coalesce(m + "real_bytes", F.lit(0)).alias("real_bytes"), F.col(m + "state"), F.col(m + "exception"),
        F.coalesce(m + "schema_only", F.lit(False)).alias("schema_only"), F.coalesce(m + "encrypted", F.lit(True)).alias("encrypted"),
        listed("access_control", "access_controls", "meta.access_control", "meta.access_controls").alias("access_control"),
        listed("user_defined_functions", "meta.user_defined_functions").alias("functions"), listed("named_collections", "meta.named_collections").alias("named_collections"),
        listed("workload_entities").alias("workload_entities"), F.col("d.databases").alias("databases"),
    )


def light(parsed: DataFrame) -> DataFrame:
    return parsed.drop("databases")


def databases(parsed: DataFrame) -> DataFrame:
    """(backup, database, engine, uuid, metadata_path, engine_full), also of databases without tables."""
    rows = parsed.select(F.col("name").alias("backup"), F.explode("databases").alias("database", "d"))
    return rows.select("backup", "database", "d.engine", "d.uuid", "d.metadata_path", "d.engine_full")


def tables(parsed: DataFrame) -> DataFrame:
    """(backup, database, table, engine, uuid)."""
    rows = parsed.select(F.col("name").alias("backup"), F.explode("databases").alias("database", "d")).select("backup", "database", F.explode("d.tables").alias("table", "t"))
    return rows.select("backup", "database", "table", "t.engine", "t.uuid")


def parts(parsed: DataFrame) -> DataFrame:
    """One row for each stored part, with the defaults of fields that older documents lack."""
    rows = parsed.select(F.col("name").alias("backup"), F.explode("databases").alias("database", "d"))
    rows = rows.select("backup", "database", F.explode("d.tables").alias("table", "t")).select("backup", "database", "table", F.col("t.engine").alias("engine"), F.explode("t.parts").alias("part", "p"))
    return rows.select(
        "backup", "database", "table", "engine", "part", "p.checksum", "p.bytes", "p.files", F.coalesce("p.tarball", F.lit(False)).alias("tarball"),
        F.nullif("p.link", F.lit("")).alias("link"), "p.link_part_name", F.coalesce("p.disk_name", F.lit("default")).alias("disk_name"), F.coalesce("p.encrypted", F.lit(True)).alias("encrypted"),
    )


def show(parsed: DataFrame, name: str, database: str | None = None, table: str | None = None) -> DataFrame:
    """The parts of one backup, of one database or table if given."""
    if table is not None and database is None:
        raise ValueError("a table needs its database")
    out = parts(parsed.where(F.col("name") == name))
    if database is not None:
        out = out.where(F.col("database") == database)
    return out if table is None else out.where(F.col("table") == table)


_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
#: Fields of a document's parts, with the columns they come from.
_META_COLUMNS = {
    "name": "name", "path": "path", "version": "version", "ch_version": "ch_version", "hostname": "hostname", "labels": "labels", "bytes": "bytes", "real_bytes": "real_bytes",
    "state": "state", "exception": "exception", "schema_only": "schema_only", "encrypted": "encrypted",
}
_LISTS = {"access_control": "access_control", "user_defined_functions": "functions", "named_collections": "named_collections", "workload_entities": "workload_entities"}
_DATABASE_COLUMNS = ("engine", "metadata_path", "uuid", "engine_full")
_TABLE_COLUMNS = ("engine", "uuid")
_PART_COLUMNS = ("checksum", "bytes", "files", "tarball", "link", "link_part_name", "disk_name", "encrypted")
#: Parts that one piece of a document holds at most, about.
PIECE = 20_000


def _fields(df: DataFrame, names: tuple[str, ...]) -> Column:
    """struct of those of the columns that df has."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in names if c in df.columns])


def _meta(backups: DataFrame) -> Column:
    """The meta field of (name or backup, hostname, state, start_time, ...); times are written as UTC instants."""
    def at(c: str) -> Column:
        local = F.col(c).cast("timestamp_ntz")
        instant = local if dict(backups.dtypes)[c] == "timestamp_ntz" else F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
        return F.concat(F.date_format(instant, _TIME), F.lit(" +0000"))

    times = [at(c).alias(c) for c in ("start_time", "end_time") if c in backups.columns]
    named = [F.col("backup").alias("name")] if "name" not in backups.columns else []
    more = [F.col(f"`{column}`").alias(field) for field, column in _META_COLUMNS.items() if column in backups.columns]
    return F.struct(*named, *more, *times, F.lit(DEFAULT_TIME_FORMAT).alias("time_format")).alias("meta")


def _lists(backups: DataFrame) -> list[Column]:
    return [F.col(f"`{column}`").alias(field) for field, column in _LISTS.items() if column in backups.columns]


def to_documents(stored: DataFrame, backups: DataFrame, databases: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(document): one JSON text a backup, for a catalogue whose backups fit a row each; `write_catalogue` has no such bound.

    stored: flat parts; backups: (backup or name, hostname, state, start_time, ...); databases and
    tables, as the functions of these names give them, also keep what has no parts. All columns
    that a document has a field for are written.
    """
    key = ["backup", "database", "table"]
    held = stored.groupBy(*key).agg(F.first("engine").alias("engine"), F.map_from_entries(F.collect_list(F.struct("part", _fields(stored, _PART_COLUMNS)))).alias("parts"))
    if tables is not None:
        named = tables.select(*key, *[c for c in _TABLE_COLUMNS if c in tables.columns])
        held = named.join(held.withColumnRenamed("engine", "_engine"), key, "full").withColumn("engine", F.coalesce("engine", "_engine")).drop("_engine")
    t = held.groupBy("backup", "database").agg(F.map_from_entries(F.collect_list(F.struct("table", _fields(held, (*_TABLE_COLUMNS, "parts"))))).alias("tables"))
    if databases is not None:
        t = databases.select("backup", "database", *[c for c in _DATABASE_COLUMNS if c in databases.columns]).join(t, ["backup", "database"], "full")
    d = t.groupBy("backup").agg(F.map_from_entries(F.collect_list(F.struct("database", _fields(t, (*_DATABASE_COLUMNS, "tables"))))).alias("databases"))
    name = "backup" if "backup" in backups.columns else "name"
    return backups.join(d.withColumnRenamed("backup", name), name, "left").select(F.to_json(F.struct(_meta(backups), F.col("databases"), *_lists(backups))).alias("document"))


def write_documents(documents: DataFrame, root: str) -> None:
    """(backup, document) as text files in one folder a backup, below root; existing backups are replaced."""
    documents.select("backup", F.col("document").alias("value")).write.partitionBy("backup").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(root)


@dataclass
class Catalogue:
    """A stored catalogue's tables: backups as `parse` gives them without databases, then databases, tables, parts."""

    backups: DataFrame
    databases: DataFrame
    tables: DataFrame
    parts: DataFrame


def _pieces(c: Catalogue, size: int) -> DataFrame:
    """(kind, backup, document): documents of one database, one table, or some of one table's parts."""
    meta = F.struct(F.col("backup").alias("name"), F.lit("created").alias("state")).alias("meta")
    document = lambda databases: F.to_json(F.struct(meta, databases.alias("databases"))).alias("document")
    of_table = lambda entry: F.create_map("database", F.struct(F.create_map("table", entry).alias("tables")))
    d = c.databases.where("backup is not null and database is not null")
    t = c.tables.where("backup is not null and database is not null and `table` is not null")
    p = c.parts.where("backup is not null and database is not null and `table` is not null and part is not null")
    key = ["backup", "database", "table"]
    n = p.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    dealt = p.join(n, key).withColumn("_piece", F.pmod(F.xxhash64("part"), F.col("_n")))
    held = dealt.groupBy(*key, "_piece").agg(F.first("engine").alias("engine"), F.map_from_entries(F.collect_list(F.struct("part", _fields(p, _PART_COLUMNS)))).alias("parts"))
    kinds = [
        ("database", d.select("backup", document(F.create_map("database", _fields(d, _DATABASE_COLUMNS))))),
        ("table", t.select("backup", document(of_table(_fields(t, _TABLE_COLUMNS))))),
        ("part", held.select("backup", document(of_table(_fields(held, ("engine", "parts")))))),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "*") for kind, df in kinds])


def write_catalogue(c: Catalogue, root: str, piece: int = PIECE) -> str:
    """Write backups' full and light documents below root; gives the name of this writing.

    A full document is written in pieces, so that no row holds a backup, in folders that are this
    writing's own: root/full/write=<name>/kind=<kind>/backup=<backup>. Light documents come last.
    A backup's light document of the latest writing says which full pieces count, so one is
    replaced at once, and a writing that breaks off changes nothing. Writing the same twice
    leaves the later one. Backups without a name are left out; repeated ones count once.
    """
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    pieces = _pieces(c, piece).withColumnRenamed("document", "value")
    pieces.repartition("kind", "backup", F.pmod(F.xxhash64("value"), F.lit(8))).write.partitionBy("kind", "backup").text(f"{root.rstrip('/')}/full/write={name}")
    b = c.backups.where("name is not null").dropDuplicates(["name"])
    b.select(F.to_json(F.struct(_meta(b), *_lists(b))).alias("value")).write.text(f"{root.rstrip('/')}/light/write={name}")
    return name


def _current(spark: SparkSession, root: str) -> DataFrame:
    """(backup, write, document): the light document of each backup's latest writing."""
    lines = spark.read.schema("value string, write string").text(f"{root.rstrip('/')}/light")
    named = lines.select(F.get_json_object("value", "$.meta.name").alias("backup"), "write", F.col("value").alias("document"))
    return named.groupBy("backup").agg(F.max(F.struct("write", "document")).alias("m")).select("backup", "m.write", "m.document")


def read_light(spark: SparkSession, root: str) -> DataFrame:
    """The backups that write_catalogue has written, as `parse` gives light documents."""
    return light(parse(_current(spark, root)))


def read_catalogue(spark: SparkSession, root: str, names: list[str] | None = None) -> Catalogue:
    """What write_catalogue has written, of all backups or of those named (whose folders alone are read)."""
    current = _current(spark, root)
    full = spark.read.schema("value string, write string, kind string, backup string").text(f"{root.rstrip('/')}/full")
    if names is not None:
        current, full = (df.where(F.col("backup").isin(*names) if names else F.lit(False)) for df in (current, full))
    full = full.join(current.select("backup", "write"), ["backup", "write"], "left_semi").withColumnRenamed("value", "document")
    of = lambda kind: parse(full.where(F.col("kind") == kind))
    return Catalogue(light(parse(current)), databases(of("database")), tables(of("table")), parts(of("part")))
