"""Which databases and tables a command is about."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.functions.ddl import glob_to_regex


def accepts(database: Column, table: Column, patterns: list[str], inverted: bool = False) -> Column:
    """Whether a table passes patterns "database.glob"; inverted: whether none fits. No patterns let all pass."""
    if not patterns:
        return F.lit(True)
    parts = [p.split(".", 1) for p in patterns]
    hit = reduce(or_, [(database == db) & table.rlike(glob_to_regex(glob)) for db, glob in parts])
    return ~hit if inverted else hit


def combined(database: Column, table: Column, include: list[str], exclude: list[str]) -> Column:
    """Both kinds of patterns together: what include accepts and exclude doesn't."""
    return accepts(database, table, include) & accepts(database, table, exclude, inverted=True)


def without_databases(df: DataFrame, names: list[str], column: str = "database") -> DataFrame:
    return df.where(~F.col(column).isin(*names)) if names else df


def only(df: DataFrame, names: list[str] | None, column: str = "table") -> DataFrame:
    """Rows whose column is among names. None is no filter, an empty list lets nothing pass."""
    return df if names is None else df.where(F.col(column).isin(*names))


def listed(df: DataFrame, names: list[str], column: str = "table") -> DataFrame:
    """As the catalogue's own queries filter: an empty list is no filter."""
    return df.where(F.array_contains(F.array(*map(F.lit, names)), F.col(column))) if names else df


def chosen_tables(df: DataFrame, specs: list[str]) -> DataFrame:
    """(database, table, ...) rows that "database.table" specs name; the first dot divides."""
    pairs = [s.split(".", 1) for s in specs]
    wanted = reduce(or_, [(F.col("database") == db) & (F.col("table") == t) for db, t in pairs], F.lit(False))
    return df.where(wanted)


def unchanged(now: DataFrame, before: DataFrame, key: list[str], stamps: list[str]) -> DataFrame:
    """Rows of now whose stamps are those seen before."""
    return now.join(before.select(*key, *stamps), [*key, *stamps], "left_semi")


def sources(flags: dict[str, Column], schema_only: Column, for_restore: bool = False) -> dict[str, Column]:
    """What takes part: if any flag is set, those (data brings its schema along); else all, on
    restore without access, and data only if it isn't schema_only."""
    any_set = reduce(or_, flags.values())
    out = {k: F.when(any_set, v).otherwise(F.lit(not (for_restore and k == "access"))) for k, v in flags.items()}
    out["schema"] = F.when(any_set, flags["schema"] | flags["data"]).otherwise(F.lit(True))
    out["data"] = F.when(any_set, flags["data"]).otherwise(~schema_only)
    return out
