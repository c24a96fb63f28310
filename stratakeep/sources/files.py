"""Files and objects as DataFrames: listings, contents, metadata documents on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, name, size, modified) of all files below root, without reading their contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content) of all files below root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "content")


def without_names(files: DataFrame, names: list[str]) -> DataFrame:
    return files.where(~F.col("name").isin(*names)) if names else files


def is_empty(files: DataFrame) -> bool:
    return files.limit(1).isEmpty()


def relative(files: DataFrame, root: str) -> DataFrame:
    """Paths as they are below root."""
    # listings give full URIs, whose root may be spelt with one slash or three
    tail = F.element_at(F.split("path", F.lit("\\Q" + root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/\\E"), 2), -1)
    return files.withColumn("path", tail)


def backup_names(spark: SparkSession, root: str) -> DataFrame:
    """(backup): the first level below root that holds files."""
    return relative(listing(spark, root), root).select(F.get(F.split("path", "/"), F.lit(0)).alias("backup")).distinct()


def orphans(names: DataFrame, parsed: DataFrame) -> DataFrame:
    """Backups that have files but no metadata document."""
    return names.join(parsed.select(F.col("name").alias("backup")), "backup", "left_anti")


def part_checksums(files: DataFrame, key: list[str], name: str = "checksums.txt") -> DataFrame:
    """(key, checksum) of parts: the md5, in hex, of the file (key, name, content) that lists their files' sums; parts without it are left out."""
    return files.where(F.col("name") == name).groupBy(*key).agg(F.max(F.md5("content")).alias("checksum"))
