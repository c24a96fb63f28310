"""Options: defaults, overrides, dotted keys, and the server's own configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def merge(base: Mapping, over: Mapping) -> dict:
    """base with over's values; where both have a mapping, merged in turn."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def from_dotted(pairs: Iterable[tuple[str, object]]) -> dict:
    """("a.b", 1) pairs as nested mappings. Of equal keys the last counts; shorter keys are set first."""
    out: dict = {}
    for key, value in sorted(dict(pairs).items(), key=lambda kv: kv[0].count(".")):
        *path, last = key.split(".")
        at = out
        for p in path:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[last] = value
    return out


def server_settings(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Rows of an XML configuration, one for each element with the tag."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
