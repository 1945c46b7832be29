"""Results on disk: strict JSON, content hashes, a cache that binds tables to what they were made from, and publication by a pointer.

These run on the driver, over small results; tables themselves are Spark's to write.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import json
import math
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "orrery-1"


class ResultError(ValueError):
    """A result that may not be written, read or published."""


def cleaned(value):
    """value with numbers that are not finite as None, and numpy's as Python's."""
    if isinstance(value, dict):
        return {str(k): cleaned(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [cleaned(v) for v in value]
    if hasattr(value, "tolist"):
        return cleaned(value.tolist())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(path: str, value) -> str:
    """Write value, whose numbers must be finite, beside the path and move it there; the SHA-256 of what is then read back."""
    text = json.dumps(value, allow_nan=False, sort_keys=True, indent=1)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    with open(path) as f:
        if f.read() != text:
            raise ResultError(f"{path} does not hold what was written")
    return hashlib.sha256(text.encode()).hexdigest()


def read_json(path: str):
    """JSON without repeated keys, NaN, infinities or numbers that overflow."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ResultError(f"{path}: repeated keys")
        return out

    def number(text):
        value = float(text)
        if not math.isfinite(value):
            raise ResultError(f"{path}: {text} is not finite")
        return value

    def constant(text):
        raise ResultError(f"{path}: {text} is not JSON")

    with open(path) as f:
        return json.load(f, object_pairs_hook=pairs, parse_float=number, parse_constant=constant)


def digest(**parts) -> str:
    """A hash of parameters; floats by their exact value."""
    exact = lambda v: v.hex() if isinstance(v, float) else {k: exact(x) for k, x in v.items()} if isinstance(v, dict) else [exact(x) for x in v] if isinstance(v, (list, tuple)) else v
    return hashlib.sha256(json.dumps(exact(parts), sort_keys=True).encode()).hexdigest()


def table_digest(df: DataFrame) -> str:
    """A hash of a table's rows in any order: the count, and sums of two hashes of each row."""
    row = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("r"))
    got = row.agg(F.count("*"), F.sum(F.xxhash64("r").cast("decimal(38,0)")), F.sum(F.crc32("r").cast("decimal(38,0)"))).first()
    return hashlib.sha256(":".join(map(str, got)).encode()).hexdigest()


def write_sorted_tsv(df: DataFrame, path: str, keys: list[str]) -> str:
    """A small table as one gzipped TSV that depends on its content alone; its SHA-256."""
    rows = df.orderBy(*keys).toLocalIterator()
    with open(path, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as f:
        f.write(("\t".join(df.columns) + "\n").encode())
        for r in rows:
            f.write(("\t".join("" if x is None else str(x) for x in r) + "\n").encode())
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def write_table(df: DataFrame, folder: str, compressed: bool = True) -> None:
    """A table of any size as tab-separated files with a header each, written by all tasks and there as a whole or not at all."""
    df.write.mode("errorifexists").csv(folder, sep="\t", header=True, compression="gzip" if compressed else "none", emptyValue="")


class Cache:
    """Tables kept under a folder by what they were made from. Whatever does not agree is a miss."""

    def __init__(self, spark: SparkSession, folder: str, namespace: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{namespace}"

    def get(self, make: Callable[[], DataFrame], inputs: str, **params) -> DataFrame:
        """The table made from inputs (a digest) by params; made and kept if it is not there, or not as it was."""
        key = digest(version=VERSION, inputs=inputs, params=params)
        path, note = f"{self.folder}/{key}.parquet", f"{self.folder}/{key}.json"
        with contextlib.suppress(OSError, ResultError, ValueError, KeyError):
            kept = read_json(note)
            found = self.spark.read.parquet(path)
            if kept["key"] == key and kept["content"] == table_digest(found) and kept["schema"] == found.schema.json():
                return found
        make().write.mode("overwrite").parquet(path)
        found = self.spark.read.parquet(path)
        write_json(note, {"key": key, "content": table_digest(found), "schema": found.schema.json(), "version": VERSION})
        return found


class Publication:
    """Attempts, each a folder that is never changed, and one pointer to the accepted one."""

    def __init__(self, folder: str):
        self.folder, self.pointer = folder, os.path.join(folder, "accepted.json")

    def attempt(self) -> str:
        path = os.path.join(self.folder, f"attempt-{uuid.uuid4().hex}")
        os.makedirs(path)
        return path

    def accept(self, attempt: str, files: list[str], replace: Callable[[str, object], str] = write_json) -> dict:
        """Point to an attempt whose files are all there; the pointer holds their hashes."""
        hashes = {}
        for name in files:
            with open(os.path.join(attempt, name), "rb") as f:
                hashes[name] = hashlib.sha256(f.read()).hexdigest()
        value = {"attempt": os.path.basename(attempt), "files": hashes}
        try:
            replace(self.pointer, value)
        except OSError as e:
            raise ResultError(f"the pointer's state is uncertain: {e}") from e
        return value

    def accepted(self) -> str | None:
        """Folder of the accepted attempt, its files as they were; None before the first."""
        if not os.path.exists(self.pointer):
            return None
        value = read_json(self.pointer)
        path = os.path.join(self.folder, value["attempt"])
        for name, was in value["files"].items():
            with open(os.path.join(path, name), "rb") as f:
                if hashlib.sha256(f.read()).hexdigest() != was:
                    raise ResultError(f"{name} has changed since it was accepted")
        return path


def run_or_block(inputs: dict[str, str], out: str, run: Callable[[], dict]) -> int:
    """Run if all inputs are there and write its result; else write a blocked one that names what is missing. 0, or 2 if blocked."""
    missing = sorted(role for role, path in inputs.items() if not os.path.exists(path))
    if missing:
        write_json(out, {"status": "blocked", "missing": missing})
        return 2
    write_json(out, {"status": "ok", **cleaned(run())})
    return 0


def reproduced(path: str, value: dict, tolerance: float = 0.0, volatile: frozenset[str] = frozenset(("timestamp", "seconds")), update: bool = False) -> bool:
    """Whether a result equals the one kept at path, volatile fields aside; kept anew if there is none or update is asked for."""
    from ..operators.gates import compare

    if update or not os.path.exists(path):
        write_json(path, value)
        return True
    return not compare(read_json(path), value, tolerance, ignore=volatile)
