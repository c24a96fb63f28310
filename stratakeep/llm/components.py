"""Connected components of an undirected graph: contraction within tasks, star contraction between them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.store import discard, materialise, merged, observed

#: Edges that one task contracts in memory (16 bytes each, and a few times that while at work).
EDGES_A_TASK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), ascending, and the least node that each can reach."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, above := root[root]):
            root = above
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _contracted(batches):
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if rows:
        nodes, root = roots(np.concatenate([u for u, _ in rows]), np.concatenate([v for _, v in rows]))
        apart = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(root[apart])], ["u", "v"])


def _towards_least(edges: DataFrame, emit: Column) -> tuple[DataFrame, DataFrame]:
    """Every node's neighbours point to the least of them all.

    The least ones are a table of their own, so that the join's both sides come from a shuffle and
    Spark may split the rows of a node with very many neighbours.
    """
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return merged(edges, least, "u").where(emit), least


def components(edges: DataFrame, max_rounds: int = 60, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(id, component) of each node of `edges` (columns a, b: long); component is the least id reachable.

    Each round first contracts the edges of every task in memory, which leaves a task an edge for
    each of its nodes at most. Where the edges of one task are all there are, that is the result;
    otherwise a large-star and a small-star step follow, which keep connectivity and shorten every
    path towards the least node, so that rounds grow with the logarithm of the graph's size. Rounds
    are written to the shared folder, superseded ones deleted. Loops and repeated edges are
    allowed; an empty input gives no rows.
    """
    state = {"x": F.bit_xor(F.xxhash64("u", "v"))}
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, before = observed(e, "edges", **state)
    for _ in range(max_rounds):
        tasks = max(1, math.ceil(before["n"] / edges_a_task))
        local = e.repartition(tasks).mapInArrow(_contracted, "u long, v long")
        if tasks == 1:
            e = local
            break
        local = materialise(local, "contracted")
        discard(e)
        both = local.unionByName(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, least = _towards_least(both, F.col("v") > F.col("u"))
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small, lower = _towards_least(large, F.lit(True))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e, after = observed(small.distinct(), "edges", **state)
        discard(local, least, large, lower)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
