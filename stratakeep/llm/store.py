"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and all of Spark is on this machine (tests) a temporary
    folder takes its place; elsewhere its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table once and read it back: cuts lineage, and a lost executor costs only a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def observed(df: DataFrame, name: str, **of: Column) -> tuple[DataFrame, dict]:
    """`materialise`, with aggregates of the rows taken as they are written; n is their count."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in of.items()]), name)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffling both sides: the driver broadcasts nothing, whatever the sizes."""
    return left.join(right.hint("merge"), on, how)
