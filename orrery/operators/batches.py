"""Batch correction of tables of any size: soft clusters that mix batches, and a ridge regression on the batch from sums of each.

What a round needs of all cells are sums by cluster, batch and feature. Tasks add them up over their cells, from the centres and
weights of the pass before, and the driver holds these sums alone: clusters times batches and features, whatever the number of
cells. A cell's memberships are never stored; they follow from its features, the centres and the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from . import cluster
from .ranks import BROADCAST_KEYS, matched, running

#: Batches that the driver and each task may hold sums of.
MAX_BATCHES = 10_000


def summed(rows: DataFrame, part: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """Sum of part(columns of a batch of rows, as pyarrow arrays), which are `size` doubles, over all rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(*batch.columns).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in rows.mapInArrow(parts, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # size rows
        out[r.i] = r.s
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)


def members(x: np.ndarray, centres: np.ndarray, sigma: float, weights: np.ndarray | None = None, code: np.ndarray | None = None) -> np.ndarray:
    """Soft membership (rows, clusters) by closeness to the centres; with weights (clusters, batches), by how rare a row's batch
    is in the cluster too."""
    soft = np.exp(-2 * (1 - unit(x) @ centres.T) / sigma)
    soft /= soft.sum(1, keepdims=True)
    if weights is not None:
        soft = soft * weights[:, code].T
        soft /= soft.sum(1, keepdims=True)
    return soft


def batch_corrected(cells: DataFrame, id_col: str, batch: str, features: str, clusters: int = 8, rounds: int = 20, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, small: int = cluster.MAX_ROWS) -> DataFrame:
    """id, features: soft clusters that mix batches, and from each a ridge regression on the batch taken off, until it settles.

    Up to `small` rows that happens on the driver, in the same steps. A null batch is a batch of its own; ids are unique.
    """
    t = pinned(cells.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(batch).cast("string"), F.lit("None")).alias("b"), F.col(features).cast("array<double>").alias("z")), "cells")
    n = t.count()
    if n <= small:
        return cluster.batch_corrected(t, "id", "b", "z", clusters, rounds, theta, sigma, ridge)
    sizes = t.groupBy("b").agg(F.count("*").alias("n")).limit(MAX_BATCHES + 1).toArrow().sort_by("b")
    if sizes.num_rows > MAX_BATCHES:
        raise ValueError(f"more than {MAX_BATCHES} batches")
    share = np.array(sizes["n"].to_pylist()) / n
    number = t.sparkSession.createDataFrame([(b, i) for i, b in enumerate(sizes["b"].to_pylist())], "b string, code int")
    k, many = min(clusters, n), sizes.num_rows
    at = sorted(set(np.linspace(0, n - 1, k).astype(int).tolist()))
    places = running(t.groupBy("id").agg(F.count("*").alias("n")), "id", ["n"]).where(F.array_contains(F.array(*map(F.lit, at)), (F.col("cum_n") - 1).cast("int"))).select("id", F.col("cum_n").alias("place"))
    first = t.join(F.broadcast(places), "id").orderBy("place").select("z").toArrow()  # k rows
    centres = unit(matrix(first["z"].combine_chunks()))
    dim = centres.shape[1]
    held = pinned(matched(t, number, ["b"], "inner", many <= BROADCAST_KEYS).select("id", "code", "z", F.col("z").alias("x")), "cells")
    for _ in range(rounds):
        for step in range(5):
            last = step == 4
            old = centres

            def seen_part(code: pa.Array, x: pa.Array, old: np.ndarray = old) -> np.ndarray:
                soft, out = members(matrix(x), old, sigma), np.zeros((many, k))
                np.add.at(out, code.to_numpy(), soft)
                return out

            seen = summed(held.select("code", "x"), seen_part, many * k).reshape(many, k).T
            weights = ((np.outer(seen.sum(axis=1), share) + 1) / (seen + 1)) ** theta

            def centre_part(code: pa.Array, z: pa.Array, x: pa.Array, old: np.ndarray = old, weights: np.ndarray = weights, last: bool = last) -> np.ndarray:
                code, x = code.to_numpy(), matrix(x)
                soft = members(x, old, sigma, weights, code)
                out = (soft.T @ unit(x)).ravel()
                if last:  # sums of memberships, and of features by them, in each cluster and batch
                    both = np.zeros((many, k, dim + 1))
                    np.add.at(both, code, soft[:, :, None] * np.hstack([np.ones((len(x), 1)), matrix(z)])[:, None, :])
                    out = np.concatenate([out, both.ravel()])
                return out

            sums = summed(held.select("code", "z", "x"), centre_part, k * dim + (many * k * (dim + 1) if last else 0))
            centres = unit(sums[: k * dim].reshape(k, dim))
        both = sums[k * dim :].reshape(many, k, dim + 1).transpose(1, 0, 2)
        effects = np.stack([_effects(b, ridge) for b in both])

        def taken_off(batches: Iterator[pa.RecordBatch], old: np.ndarray = old, weights: np.ndarray = weights, effects: np.ndarray = effects) -> Iterator[pa.RecordBatch]:
            for one in batches:
                if one.num_rows:
                    code, z, x = one.column(1).to_numpy(), matrix(one.column(2)), matrix(one.column(3))
                    soft = members(x, old, sigma, weights, code)
                    new = z - sum(soft[:, [c]] * effects[c, code] for c in range(len(effects)))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(new.ravel()), new.shape[1]).cast(pa.list_(pa.float64()))
                    moved = [float(np.abs(new - x).max(initial=0)), float(np.abs(x).max(initial=0))]
                    yield pa.RecordBatch.from_arrays([*one.columns[:3], lists, *(pa.array([m] * one.num_rows) for m in moved)], names=["id", "code", "z", "x", "moved", "size"])

        new = pinned(held.mapInArrow(taken_off, "id long, code int, z array<double>, x array<double>, moved double, size double"), "cells")
        far = new.agg(F.max("moved").alias("moved"), F.max("size").alias("size")).first()
        held = new.select("id", "code", "z", "x")
        if far.moved < 1e-4 * max(1e-12, far.size):
            break
    return held.select("id", F.col("x").alias("features"))


def _effects(sums: np.ndarray, ridge: float) -> np.ndarray:
    """What each batch adds to a cluster's features (batches, features), from sums (batches, 1 + features) of memberships and of
    features by them: regression on an intercept and the batches, these with a penalty."""
    size, s = sums[:, :1], sums[:, 1:]
    left = size + ridge + 1e-9  # batches meet only through the intercept, so that it is solved for first
    intercept = (s.sum(axis=0) - (size * s / left).sum(axis=0)) / (size.sum() + 1e-9 - (size * size / left).sum())
    return (s - size * intercept) / left
