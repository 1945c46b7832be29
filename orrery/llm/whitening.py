"""Principal components and whitening of embeddings by block Lanczos.

The covariance is never made: a pass over the vectors gives its product with a block of directions, each task adding up
Xc'(Xc B) of its centred rows. The Krylov space of these blocks is kept orthonormal by orthogonalising every new block twice
against all of it; directions that vanish there (a breakdown) are replaced by random ones, so that an invariant subspace does
not hide what lies outside it. The wanted components are taken once the residuals of their Ritz vectors are at rounding. What
the driver holds follows the width of the vectors, not their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, small_batches, staged
from .vafile import quantised

#: Directions of a block; columns of the basis before it is restarted from its best Ritz vectors; passes before giving up.
BLOCK, BASIS, PASSES = 16, 512, 400
#: A residual of this share of the largest eigenvalue is rounding; directions shorter than this share are a breakdown.
RESIDUAL, BREAKDOWN = 1e-13, 1e-10
#: Where rounding in the passes is larger, residuals below this share that no longer fall are as good as they get.
SETTLED = 1e-9
#: Squares are summed in 64-bit integers where they fit, else in Python's.
WORD = float(1 << 62)


def matrix(column: pa.Array, dim: int, what: str = "vectors of unlike length") -> np.ndarray:
    """Rows of a column of integer arrays without nulls, all of length dim."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim or (pa.compute.list_value_length(column).to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(what)
    return flat.reshape(len(column), dim)


def _summed(rows: DataFrame, dim: int, part, size: int) -> np.ndarray:
    """Sum over all rows of part(x), arrays of `size` doubles, x a matrix of some rows' vectors."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0), dim)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in rows.select("v").mapInArrow(parts, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # size rows
        out[r.i] = r.s
    return out


def _exactly(rows: DataFrame, dim: int, part, size: int) -> list[int]:
    """The same for integers, part(x) a list of them, exactly."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            if batch.num_rows:
                total = [a + b for a, b in zip(total, part(matrix(batch.column(0), dim)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "s"])

    found = rows.select("v").mapInArrow(parts, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = [0] * size
    for r in found:
        out[r.i] = int(r.s)
    return out


def _column_sums(x: np.ndarray) -> list[int]:
    high, low = x >> 28, x & (1 << 28) - 1  # sums of halves fit
    return [(h << 28) + l for h, l in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum of (n x - S)^2 over the components of each row, exactly."""
    most = max(n * int(np.abs(x).max(initial=0)) + abs(s) for s in sums) if sums else 0
    if float(most) ** 2 * max(1, x.shape[1]) < WORD:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [int(s) for s in (d * d).sum(axis=1)]


def _orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator, scale: float) -> np.ndarray:
    """An orthonormal block for what of `block` lies outside the basis, with random directions for those that vanish there."""
    room = min(block.shape[1], len(basis) - basis.shape[1])
    out = np.zeros((len(basis), 0))
    fresh = list(block.T)
    while out.shape[1] < room:
        v = fresh.pop(0) if fresh else random.standard_normal(len(basis)) * scale
        size = np.linalg.norm(v)
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > BREAKDOWN * max(size, BREAKDOWN * scale) and left > 0:
            v = v / left
            for _ in range(2):
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
            out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out


def block_lanczos(product, dim: int, k: int, block: int = BLOCK, most: int = BASIS, residual: float = RESIDUAL, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, falling, and unit eigenvectors as columns; product(B) is the matrix
    times a block of columns. A basis of `most` columns is restarted from its best Ritz vectors, one of dim columns is exact."""
    k, block = min(k, dim), min(block, dim)
    most = max(most, 4 * block + 2 * k)
    random = np.random.default_rng(seed)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    new = _orthonormal(random.standard_normal((dim, block)), basis, random, 1.0)
    last: list[float] = []
    for _ in range(PASSES):
        basis, image = np.hstack([basis, new]), np.hstack([image, made := product(new)])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, error = basis @ turns[:, :k], image @ turns[:, :k] - basis @ turns[:, :k] * values[:k]
        scale = max(float(values[0]), 0.0)
        last.append(float(np.linalg.norm(error, axis=0).max()))
        settled = last[-1] <= SETTLED * scale and len(last) > 4 and last[-1] > last[-5] / 2
        if basis.shape[1] >= dim or basis.shape[1] >= k and (last[-1] <= residual * scale or settled):
            return values[:k], ritz / np.linalg.norm(ritz, axis=0)
        # what the next Krylov block adds to all of the basis, also where only its best part is kept
        new = _orthonormal(made - basis @ (basis.T @ made), basis, random, scale or 1.0)
        if basis.shape[1] + block > most:
            keep = max(k + block, most // 2)
            basis, image = basis @ turns[:, :keep], image @ turns[:, :keep]
    raise ArithmeticError(f"{PASSES} passes were not enough for {k} components")


def fitted(rows: DataFrame, k: int) -> dict | None:
    """n, sums, values, axes, trace, identity_error of the distinct vectors v of rows; None where there are none."""
    fit = staged(rows.select("v").distinct(), "fit")
    one = fit.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if not one.n:
        discard(fit)
        return None
    if one.lo != one.hi:
        raise ValueError("vectors of unlike length")
    n, dim = one.n, one.hi
    sums = _exactly(fit, dim, _column_sums, dim)
    total = _exactly(fit, dim, lambda x: [sum(deviations(x, n, sums))], 1)[0]
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def product(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ b)

        return _summed(fit, dim, part, b.size).reshape(b.shape) / n

    values, axes = block_lanczos(product, dim, k) if dim and total else (np.zeros(0), np.zeros((dim, 0)))
    good = values > max(values, default=0) * dim * np.finfo(float).eps  # without variance nothing can be scaled
    values, axes = values[good], axes[:, good]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]) if axes.size else axes
    turned, m = axes / np.sqrt(values), len(values)

    def second(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turned
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    error = 0.0
    if m:
        moments = _summed(fit, dim, second, m * m + m) / n
        error = float(np.abs(moments[: m * m].reshape(m, m) - np.outer(moments[m * m :], moments[m * m :]) - np.eye(m)).max())
    discard(fit)
    return {"n": n, "sums": sums, "mean": mean, "values": values, "turned": turned, "trace": float(Fraction(total, n**3)), "identity_error": error}


def whiten(vectors: DataFrame, k: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of vectors (vec_id, embedding) and each of
    the k components of largest variance of x = floor(scale * embedding), over the distinct x.

    deviation, a decimal, is the sum over dimensions of (n x - S)^2, exactly; whitened the centred x on the component, over the
    root of its variance; explained the component's share of all variance, whose trace comes from the deviations;
    identity_error how far the covariance of whitened values is from the identity. The largest entry of a component is positive.

    Vectors that are null or hold null or non-finite entries take no part. Repeated rows have rows of their own, and equal
    vectors are fitted once. Directions without variance are no components: one distinct vector gives no rows, as do empty
    tables and empty vectors. Vectors of unlike length and entries that vafile.quantised refuses are errors. Other columns are
    not read.
    """
    small_batches(vectors.sparkSession)
    rows = staged(vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("v")).where("v is not null"), "vectors")
    model = fitted(rows, k)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    m = len(model["values"]) if model else 0
    if not m:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, mean, turned, error = (model[x] for x in ("n", "sums", "mean", "turned", "identity_error"))
    explained = model["values"] / model["trace"]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), len(mean))
            size = batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(size), m)))
            far = pa.array([d for d in deviations(x, n, sums) for _ in range(m)], pa.decimal128(38, 0))
            columns = [ids, pa.array(np.tile(np.arange(1, m + 1), size), pa.int32()), pa.array(np.full(size * m, n), pa.int64()), far, pa.array(((x - mean) @ turned).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema)
