"""Trees of named objects, and unions of kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depths(entities: DataFrame, most: int = 1_000) -> DataFrame:
    """(name, parent, depth): order in which a tree can be created, parents first.

    A parent that isn't there is an error, as is a tree of more than `most` levels. Entities on or
    below a cycle have no depth that works, so they come last, with a depth of -1.

    Every round doubles the step of a pointer to an ancestor, so that rounds grow with the
    logarithm of the depth; a pointer that hasn't reached the top after them is on a cycle.
    """
    entities = entities.select("name", "parent")
    absent = entities.where("parent is not null").join(entities.select(F.col("name").alias("parent")), "parent", "left_anti")
    if (row := absent.first()) is not None:
        raise ValueError(f"parent {row.parent} of {row.name} isn't there")
    # (name, the ancestor that many levels up or null above the top, levels)
    steps = entities.select("name", F.col("parent").alias("above"), F.col("parent").isNotNull().cast("int").alias("levels"))
    for _ in range(entities.count().bit_length()):  # a path without a cycle is no longer than that
        further = steps.select(F.col("name").alias("above"), F.col("above").alias("next"), F.col("levels").alias("more"))
        steps = steps.join(further, "above", "left").select("name", F.col("next").alias("above"), (F.col("levels") + F.coalesce("more", F.lit(0))).alias("levels"))
        steps = steps.checkpoint() if steps.sparkSession.sparkContext.getCheckpointDir() else steps.persist()
        if steps.where("above is not null").isEmpty():
            break
    depth = F.when(F.col("above").isNull(), F.col("levels")).otherwise(-1)
    placed = entities.join(steps.select("name", depth.alias("depth")), "name").select("name", "parent", "depth")
    if (deep := steps.where(F.col("above").isNull() & (F.col("levels") > most)).first()) is not None:
        raise ValueError(f"{deep.name} is {deep.levels} levels down, over {most}")
    return placed


def tagged(frames: list[tuple[DataFrame, str]], tag: str) -> DataFrame:
    """One frame of several, each with its tag."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for df, name in frames])
