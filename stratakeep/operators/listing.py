"""Object listings against what should be there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.functions.sizes import aligned


def frozen_parts(files: DataFrame, by: list[str], alignment: int = 512) -> DataFrame:
    """One row for each part of (by, file, size): its files, sorted, and their aligned size."""
    return files.groupBy(*by).agg(F.array_sort(F.collect_list("file")).alias("files"), F.sum(aligned(F.col("size"), alignment)).alias("size"))


def existence(wanted: DataFrame, objects: DataFrame, path: str) -> DataFrame:
    """wanted with there and the object's size."""
    return wanted.join(objects.select(path, "size").withColumn("_there", F.lit(True)), path, "left").withColumn("there", F.coalesce("_there", F.lit(False))).drop("_there")


def valid_parts(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """wanted (key, files, tarball, size) with valid, by stored (key, file, size).

    A tarball part is one object of the expected size; any other part needs all its files.
    """
    have = stored.groupBy(*key).agg(F.collect_set("file").alias("_files"), F.sum("size").alias("_size"))
    out = wanted.join(have, key, "left")
    whole = F.size(F.array_except("files", F.coalesce("_files", F.array().cast("array<string>")))) == 0
    return out.withColumn("valid", F.coalesce(whole & (~F.col("tarball") | (F.col("_size") == F.col("size"))), F.lit(False))).drop("_files", "_size")


def first_of(preferred: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of preferred, and those of other whose key preferred lacks: a single legacy file wins over its pieces."""
    return preferred.unionByName(other.join(preferred.select(*key), key, "left_anti"))
