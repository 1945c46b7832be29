"""Connected components of an edge table: a small one in one task, a larger one by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged

#: Edges that one task joins by itself; more are contracted in rounds.
EDGES_AT_ONCE = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task; each set is named by its least node."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    u, v = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
    u, v = u[u != v], v[u != v]
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    top = list(range(len(nodes)))
    for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while top[i] != i:
            top[i] = i = top[top[i]]
        while top[j] != j:
            top[j] = j = top[top[j]]
        if i != j:
            top[max(i, j)] = min(i, j)
    for i, t in enumerate(top):  # a node's set is named by a lesser one, which is done
        top[i] = top[t]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[np.array(top, np.int64)], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node reachable), for every node that has an edge to another.

    Up to EDGES_AT_ONCE edges (16 MB) are joined by one task. Beyond, rounds are written to the shared folder; their number
    grows with the logarithm of the longest path. No edges, no rows.
    """
    if edges.count() <= EDGES_AT_ONCE:
        return edges.select(a, b).repartition(1).mapInArrow(_joined, "node long, component long")
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        after = staged(_small_star(_large_star(now)), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if found == state:
            break
        state = found
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
