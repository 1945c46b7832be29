"""Vector codes by parts: codebooks of Lloyd's rounds whose sums are kept up by what changes.

Vectors of integers are cut into equal parts, and each part has a codebook. A round assigns every part to its nearest entry and
writes the assignments beside those of the round before; of the parts whose entry changed alone a task adds up what the new
entry gains and the old one loses, and only these sums are shuffled. They are added to the running sums, integers throughout,
and so the entries of every round are those of full sums, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, small_batches, staged
from .vafile import quantised
from .whitening import matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Distances are taken in doubles or 64-bit integers where these hold them exactly, else in Python's integers.
EXACT, WORD = float(1 << 53), float(1 << 62)
#: Numbers of hash cells whose least ids bound the smallest ids; label totals that are broadcast at most.
CELLS, BROADCAST_LABELS = 64, 100_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (rows, width) the index of its nearest entry of book (entries, width), the lowest of equals, and the
    squared distance: integers, exactly."""
    width = max(1, x.shape[1])
    most = float(int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0)))
    if most * most * width < EXACT:
        a, b = x.astype(float), book.astype(float)
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    else:
        kind = np.int64 if most * most * width < WORD else object
        far = np.zeros((len(x), len(book)), kind)
        for j in range(x.shape[1]):
            d = x[:, j].astype(kind)[:, None] - book[:, j].astype(kind)
            far += d * d
    best = far.argmin(axis=1)
    least = far[np.arange(len(x)), best]
    return best.astype(np.uint8), least if least.dtype == object else least.astype(np.int64)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances (rows, parts) of vectors x by codebooks (parts, entries, width)."""
    parts, _, width = books.shape
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums (parts, entries, width) and counts (parts, entries) gain and lose by the parts of x whose entry changed."""
    parts, width = new.shape[1], x.shape[1] // new.shape[1]
    kind = np.int64 if float(np.abs(x).max(initial=0)) * len(x) < WORD else object
    sums, counts = np.zeros((parts, entries, width), kind), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        rows = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        some = x[rows, p * width : (p + 1) * width].astype(kind)
        for codes, sign in [(new, 1)] + [(old, -1)] * (old is not None):
            np.add.at(sums[p], codes[rows, p], sign * some)
            np.add.at(counts[p], codes[rows, p], sign)
    return sums, counts


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _round(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, v[, code]) with code by these codebooks, and was, the code before."""
    dim, first = books.shape[0] * books.shape[2], "code" not in rows.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, _ = assigned(matrix(batch.column(2), dim), books)
                was = pa.nulls(batch.num_rows, pa.binary()) if first else batch.column(3)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), was], names=["vec_id", "label", "v", "code", "was"])

    kept = rows.select("vec_id", "label", "v", *([] if first else ["code"]))
    return kept.mapInArrow(coded, kept.select("vec_id", "label", "v").schema.add("code", "binary").add("was", "binary"))


def _changed(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[dict, dict]:
    """Place -> change of its sum, and of its count, over all rows whose code is not what it was. A place is a component of an
    entry of a part."""
    parts, entries, width = shape

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                old = None if batch.column(2).null_count else _codes(batch.column(2), parts)
                s, c = changes(matrix(batch.column(0), parts * width), old, _codes(batch.column(1), parts), entries)
                sums, counts = sums + s, counts + c
        at = np.flatnonzero((sums != 0).any(axis=2) | (counts != 0))
        for p in at.tolist():
            values = [int(s) for s in sums.reshape(-1, width)[p]]
            yield pa.RecordBatch.from_arrays([pa.array([p] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()), pa.array([int(counts.ravel()[p]), *values], pa.decimal128(38, 0))], names=["entry", "place", "change"])

    some = rows if "was" not in rows.columns else rows.where("was is null or was <> code")
    found = some.select("v", "code", "was").mapInArrow(moved, "entry int, place int, change decimal(38,0)").groupBy("entry", "place").agg(F.sum("change").alias("change"))
    sums, counts = {}, {}
    for r in found.collect():  # parts * entries * (width + 1) rows at most
        (counts if r.place < 0 else sums)[r.entry if r.place < 0 else (r.entry, r.place)] = int(r.change)
    return sums, counts


def first_vectors(rows: DataFrame, k: int) -> list[list[int]]:
    """v of the k rows with the smallest vec_ids, null ones last, equal ones by their vectors.

    The k-th smallest of the least ids of 64 k hash cells bounds them, so that only rows up to it are sorted.
    """
    least = rows.where("vec_id is not null").groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(CELLS * k)).alias("cell")).agg(F.min("vec_id").alias("least"))
    found = sorted(r.least for r in least.collect())  # 64 k at most
    some = rows.where(F.col("vec_id") <= found[k - 1]) if len(found) >= k else rows
    return [list(r.v) for r in some.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(k).collect()]


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 256.0) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code (bytes), error of each row of vectors (vec_id, embedding, label), and the codebooks (parts, entries,
    width) after the rounds; error is the squared distance of floor(scale * embedding) from what its code stands for.

    Codebooks start as the parts of the vectors with the smallest vec_ids, fewer where there are fewer, and an entry that no part
    has stays. Vectors that are null or hold null or non-finite entries take no part; repeated rows count each; a null vec_id
    and a null label stay. An empty table has no rows and no codebooks. Vectors whose length is unlike, or no multiple of parts,
    are an error, as are entries that vafile.quantised refuses. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("entries are numbered by one byte")
    rows = staged(vectors.select("vec_id", F.col(label).alias("label"), quantised(F.col("embedding"), scale).alias("v")).where("v is not null"), "vectors")
    kind = rows.select("vec_id", "label").schema.add("code", "binary").add("error", "decimal(38,0)")
    start = first_vectors(rows, entries)
    if not start:
        return rows.sparkSession.createDataFrame([], kind), None
    dim = len(start[0])
    if dim % parts or any(len(v) != dim for v in start):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = np.array(start, np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()
    flat = books.reshape(parts * len(start), dim // parts)  # a view: one row for each entry
    sums, counts = [[0] * flat.shape[1] for _ in flat], [0] * len(flat)
    held = rows
    for _ in range(rounds):
        before, held = held, staged(_round(held, books), "codes")
        discard(before)
        more, number = _changed(held, books.shape)
        for e, c in number.items():
            counts[e] += c
        for (e, j), s in more.items():
            sums[e][j] += s
        for e, c in enumerate(counts):
            if c:
                flat[e] = [s // c for s in sums[e]]
    final = books.copy()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, far = assigned(matrix(batch.column(2), dim), final)
                error = [sum(r) for r in far.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.decimal128(38, 0))], names=["vec_id", "label", "code", "error"])

    out = staged(held.select("vec_id", "label", "v").mapInArrow(judged, kind), "coded")
    discard(held)
    return out, final


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over equal labels, nulls together. Totals of few labels are broadcast; more meet
    the rows by label, where Spark splits the rows of a hot one."""
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").cast("decimal(38,0)").alias("label_error"))
    few = totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
