"""Statements of databases and tables as they are stored: members of an archive, or in older backups files of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.functions.names import quote_path, unquoted
from stratakeep.operators.listing import first_of

_SUFFIX = ".sql"


def statement_members(tables: DataFrame, databases: DataFrame) -> DataFrame:
    """(archive, name, content): members for statements of tables (database, table, statement) and databases (database, statement).

    A database's tables are in its own archive, all databases in `databases`; names are quoted as in
    storage. Objects without a statement are left out, repeated ones count once.
    """
    file = lambda c: F.concat(quote_path(F.col(c)), F.lit(_SUFFIX))
    rows = tables.where("statement is not null").select(quote_path(F.col("database")).alias("archive"), file("table").alias("name"), "statement")
    rows = rows.unionByName(databases.where("statement is not null").select(F.lit("databases").alias("archive"), file("database").alias("name"), "statement"))
    return rows.groupBy("archive", "name").agg(F.max("statement").alias("statement")).select("archive", "name", F.encode("statement", "UTF-8").alias("content"))


def table_statements(members: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(database, table, statement) of archive members (archive, name, content).

    legacy: (path, content) of files .../metadata/<database>/<table>.sql, for databases without an
    archive. The archive `databases`, and names that aren't quoted as in storage, are left out.
    """
    columns = [unquoted(F.col("archive")).alias("database"), unquoted(F.regexp_replace("name", r"\.sql\z", "")).alias("table"), F.decode("content", "UTF-8").alias("statement")]
    packed = members.where((F.col("archive") != "databases") & F.endswith("name", F.lit(_SUFFIX))).select(*columns)
    if legacy is not None:
        part = lambda k: F.regexp_extract("path", r"(?:\A|/)metadata/([^/]+)/([^/]+)\.sql\z", k)
        old = legacy.where(part(1) != "").select(part(1).alias("archive"), part(2).alias("name"), "content").select(*columns)
        packed = first_of(packed, old, ["database"])
    return packed.where("database is not null and `table` is not null")


def database_statements(members: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(database, statement) of the archive `databases`; legacy: files .../metadata/<database>.sql, for those it lacks."""
    columns = [unquoted(F.regexp_replace("name", r"\.sql\z", "")).alias("database"), F.decode("content", "UTF-8").alias("statement")]
    packed = members.where((F.col("archive") == "databases") & F.endswith("name", F.lit(_SUFFIX))).select(*columns)
    if legacy is not None:
        name = F.regexp_extract("path", r"(?:\A|/)metadata/([^/]+)\.sql\z", 1)
        packed = first_of(packed, legacy.where(name != "").select(name.alias("name"), "content").select(*columns), ["database"])
    return packed.where("database is not null")
