"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln1p(x: Column) -> Column:
    return F.log(F.lit(1.0) + x)


def expm1(x: Column) -> Column:
    return F.exp(x) - 1.0


def tpm_from_log2(x: Column) -> Column:
    """Inverse of log2(tpm / 10 + 1), never below zero."""
    return F.greatest((F.pow(F.lit(2.0), x) - 1.0) * 10.0, F.lit(0.0))


def clip(x: Column, bound: float) -> Column:
    return F.least(F.greatest(x, F.lit(-bound)), F.lit(bound))


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def to_number(x: Column) -> Column:
    """A string's number, null where it is none."""
    return x.try_cast("double")


def draw(seed: int, stage: str, *ids: Column) -> Column:
    """The hash that a named random stream gives to a row: samplers order by it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stage), *(c.cast("string") for c in ids)))


def draw_index(seed: int, stage: str, n: Column, *ids: Column) -> Column:
    """An index from 0 to n - 1 drawn by the same hash."""
    return F.pmod(F.conv(F.substring(draw(seed, stage, *ids), 1, 8), 16, 10).cast("bigint"), n)


def mean_std(values: Column, ddof: int) -> tuple[Column, Column]:
    return F.avg(values), F.stddev_pop(values) if ddof == 0 else F.stddev_samp(values)
