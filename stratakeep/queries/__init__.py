"""Registered queries: of each name a function of (spark, sf_dir) and the DuckDB SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self:
                raise KeyError(name)
            self[name] = (f, sql)
            return f

        return keep


def all_queries() -> Registry:
    from stratakeep.queries import catalogue, names, reconciling, restoring, sizes, transferring

    out = Registry()
    for module in (catalogue, names, reconciling, restoring, sizes, transferring):
        out.update(module.registry)
    return out
