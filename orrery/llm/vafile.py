"""Exact top-k inner products with vector-approximation files.

Of each vector the file holds an approximation: for every component the cell of a grid it lies in. First the cells alone
are scanned, block by block, for bounds of the scores; a vector stays in question where its upper bound reaches the k-th
lower bound, of its block and then of all blocks. Exact vectors are then read in the order of their bounds: those with the
best bounds first, and of the others those whose bound reaches the k-th score found, until no other can be among the k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, small_batches, staged

#: Vectors of a block, queries of a block, cells of a component's grid; queries' bytes that are broadcast at most.
BLOCK, QUERY_BLOCK, CELLS, BROADCAST_BYTES = 4096, 512, 64, 64 << 20
#: Sums of products are exact in doubles up to here.
EXACT = float(1 << 53)
#: Components of this size or more are an error: their products with others would not fit what follows.
LARGEST = 1 << 55

BLOCK_SCHEMA = "dim int, ids binary, uids binary, grid binary, cells binary, deal long"
QUERY_SCHEMA = "q_dim int, q_ids binary, q_uids binary, q_vectors binary"


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component x, as double; null for a vector that is null or holds null or non-finite components.
    A component of LARGEST or more is an error."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    small = F.forall(embedding, lambda x: F.abs(F.lit(scale) * x.cast("double")) < LARGEST)
    safe = F.when(small, embedding).otherwise(F.raise_error(F.lit("a component is too large for exact scores")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(safe, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def _grid(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value and width of a cell, by component; and the cells."""
    low = vectors.min(axis=0)
    width = (vectors.max(axis=0) - low) // CELLS + 1
    return np.stack([low, width]), ((vectors - low) // width).astype(np.uint8)


def _gathered(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """dim, uids, ids and vectors of at most size rows (uid, vec_id, v) of one length each."""
    held: dict[int, list] = {}

    def full(dim: int) -> tuple:
        taken = held.pop(dim)
        uids, ids = (np.array(x, np.int64) for x in zip(*((r[0], r[1]) for r in taken)))
        return dim, uids, ids, np.array([r[2] for r in taken], np.int64).reshape(len(taken), dim)

    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            dim = len(row[2])
            held.setdefault(dim, []).append(row)
            if len(held[dim]) == size:
                yield full(dim)
    for dim in list(held):
        yield full(dim)


def approximations(vectors: DataFrame) -> DataFrame:
    """The file's blocks: of at most BLOCK vectors (uid, vec_id, v) of one length each the ids, the grid and the cells; no vector."""
    size = BLOCK

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, uids, ids, v in _gathered(batches, size):
            grid, cells = _grid(v) if dim else (np.zeros((2, 0), np.int64), np.zeros((len(v), 0), np.uint8))
            values = [dim, ids.tobytes(), uids.tobytes(), grid.tobytes(), cells.tobytes(), int(uids[0]) * 0x9E3779B97F4A7C15 % (1 << 62)]
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=["dim", "ids", "uids", "grid", "cells", "deal"])

    return vectors.select("uid", "vec_id", "v").mapInArrow(made, BLOCK_SCHEMA)


def query_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of at most QUERY_BLOCK queries (uid, vec_id, v) of one length each, with their vectors."""
    size = QUERY_BLOCK

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, uids, ids, v in _gathered(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, uids, v))], names=["q_dim", "q_ids", "q_uids", "q_vectors"])

    return vectors.select("uid", "vec_id", "v").mapInArrow(made, QUERY_SCHEMA)


def bounds(queries: np.ndarray, grid: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the queries' scores with the vectors in these cells: of either sign of a query's component
    the nearer and the farther side of the cell."""
    limit = int(np.abs(grid[0]).max(initial=0)) + CELLS * int(grid[1].max(initial=0))
    kind = np.float64 if limit * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < EXACT else object
    q, low, width = queries.astype(kind), grid[0].astype(kind), grid[1].astype(kind)
    # low side of all cells, and how far the bounds lie from there
    side = (q * width) @ cells.astype(kind).T + (q @ low)[:, None]
    slack = q * (width - 1)
    return side + np.minimum(slack, 0).sum(axis=1)[:, None], side + np.maximum(slack, 0).sum(axis=1)[:, None]


def in_question(lower: np.ndarray, upper: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block that can be among a query's k best: all whose upper bound reaches the k-th lower bound; not its own row."""
    rows = np.flatnonzero(~own)
    if len(rows) > k:
        sure = np.sort(lower[rows]) if lower.dtype == object else np.partition(lower[rows], len(rows) - k)
        rows = rows[upper[rows] >= sure[len(rows) - k]]
    return rows


def scan(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q_uid, query_id, uid, lower, upper: what is in question after the scan of each block's cells."""
    spark = held.sparkSession
    size = asked.agg(F.sum(F.length("q_vectors") + F.length("q_ids") + F.length("q_uids"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = held.join(F.broadcast(asked), held["dim"] == asked["q_dim"])
    else:
        deals = max(1, held.count())
        dealt = asked.withColumn("q_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))))
        met = held.join(dealt, (F.pmod("deal", F.lit(deals)) == F.col("q_deal")) & (held["dim"] == asked["q_dim"]))
    kinds = "q_uid long, query_id long, uid long, lower decimal(38,0), upper decimal(38,0)"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, uids, q_ids, q_uids = (np.frombuffer(row[x], np.int64) for x in ("ids", "uids", "q_ids", "q_uids"))
                grid, cells = np.frombuffer(row["grid"], np.int64).reshape(2, dim), np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
                lower, upper = bounds(np.frombuffer(row["q_vectors"], np.int64).reshape(len(q_ids), dim), grid, cells)
                out: list[list] = [[], [], [], [], []]
                for i in range(len(q_ids)):
                    rows = in_question(lower[i], upper[i], uids == q_uids[i], k)
                    for column, values in zip(out, ([q_uids[i]] * len(rows), [q_ids[i]] * len(rows), uids[rows].tolist(), lower[i][rows].tolist(), upper[i][rows].tolist())):
                        column += values
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array([int(x) for x in c], pa.decimal128(38, 0)) for c in out[3:])], names=["q_uid", "query_id", "uid", "lower", "upper"])

    small_batches(spark)
    return met.select("dim", "ids", "uids", "grid", "cells", "q_ids", "q_uids", "q_vectors").mapInArrow(scanned, kinds)


def scored(asked: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """q_uid, query_id, uid, vec_id, score of the vectors that are asked for, which alone are read."""
    q = queries.select(F.col("uid").alias("q_uid"), F.col("v").alias("q"))
    read = asked.select("q_uid", "query_id", "uid").join(q, "q_uid").join(vectors.select("uid", "vec_id", "v"), "uid")
    wide = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    near = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    most = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: F.abs(x).cast("double"))), F.lit(0.0))
    fits = most("q") * most("v") * F.size("v") < EXACT
    return read.select("q_uid", "query_id", "uid", "vec_id", F.when(fits, near).otherwise(wide.cast("bigint")).alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that is_query holds for, the k rows but
    itself with the highest integer inner products, or all if fewer, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part; a vector meets those of its own length. A
    repeated row is a row of its own, so its copies find each other. A component of LARGEST or more and a score beyond 64
    bits are errors. Empty tables give no rows; other columns are not read. Of rows with equal vectors only the k + 1 with
    the smallest vec_ids can be a query's best, so the others are left out as candidates.
    """
    small_batches(vectors.sparkSession)
    whole = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    rows = staged(whole.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    alike = Window.partitionBy("v").orderBy("vec_id", "uid")
    candidates = staged(rows.select("uid", "vec_id", "v", F.row_number().over(alike).alias("r")).where(F.col("r") <= k + 1).drop("r"), "candidates")
    asks = rows.where("asks")
    asked = staged(query_blocks(asks.repartition(max(1, -(-asks.count() // QUERY_BLOCK)), "uid")), "queries")
    held = staged(approximations(candidates), "approximations")
    found = staged(scan(held, asked, k), "bounds")

    by = Window.partitionBy("q_uid")
    sure = found.withColumn("r", F.row_number().over(by.orderBy(F.desc("lower"), "uid"))).where(F.col("r") == k).select("q_uid", F.col("lower").alias("kth"))
    left = found.join(sure, "q_uid", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    left = staged(left.withColumn("place", F.row_number().over(by.orderBy(F.desc("upper"), "uid"))).select("q_uid", "query_id", "uid", "upper", "place"), "left")
    first = staged(scored(left.where(F.col("place") <= k), asks, candidates), "scores")
    kth = first.groupBy("q_uid").agg(F.min("score").cast("decimal(38,0)").alias("kth"))
    more = scored(left.where(F.col("place") > k).join(kth, "q_uid").where(F.col("upper") >= F.col("kth")), asks, candidates)
    best = first.unionByName(more).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id", "uid"))).where(F.col("rank") <= k)
    out = staged(best.select("query_id", "rank", "vec_id", "score"), "best")
    discard(rows, candidates, asked, held, found, left, first)
    return out
