"""Ranks and running totals over a whole table without sending it, or a key with much of it, to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned

#: A key of more than 1 / HOT of all rows, and of more than SMALL rows, is dealt into PARTS ranges of about equal numbers of rows.
PARTS, HOT, SMALL = 256, 64, 1 << 17
#: Tables of one row for each key that are broadcast at most.
BROADCAST_KEYS = 100_000


def matched(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", broadcast: bool = True, where: Column | None = None) -> DataFrame:
    """df with the other columns of small where its keys are equal, nulls too, and `where` holds."""
    named = small.select(*(F.col(k).alias(f"__of_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    tests = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + ([] if where is None else [where])
    on = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    return df.join(F.broadcast(named) if broadcast else named, on, how).drop(*(f"__of_{k}" for k in keys))


def coarse(cuts: Column, step: int) -> Column:
    """Every step-th of ascending cuts, for part_of."""
    return F.filter(cuts, lambda _, i: i % step == step - 1)


def part_of(value: Column, cuts: Column, every: Column, step: int) -> Column:
    """Number of ascending cuts below the value: among every step-th of them first, then among those between."""
    first = F.size(F.filter(every, lambda c: c < value))
    return first * step + F.size(F.filter(F.slice(cuts, first * step + 1, F.lit(step - 1)), lambda c: c < value))


def running(df: DataFrame, value: str, sums: list[str], keys: list[str] = (), totals: bool = False, parts: int = PARTS, small: int = SMALL) -> DataFrame:
    """df with cum_<c> for each c in sums: the total of c over the rows with the same keys and value up to this row's; and, if
    asked for, with total_<c>, that over all rows with the same keys.

    df has one row for each keys and value. Without a hot key a window does. The rows of a hot key, of which there are fewer
    than HOT, are dealt into ranges by cuts of approximate quantiles, each is summed alone, and the totals of the ranges before
    are added: whole numbers give what the window gives. Null keys are a key.
    """
    keys = list(keys)
    held = pinned(df, "values")
    sizes = held.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"total_{c}") for c in sums))
    n = sizes.agg(F.sum("__n").alias("rows"), F.max("__n").alias("most"), F.count("*").alias("keys")).first()
    limit = max(small, (n.rows or 0) // HOT)
    shown = [*df.columns, *(f"cum_{c}" for c in sums)]
    if (n.most or 0) <= limit:
        by = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        out = held.select("*", *(F.sum(c).over(by).alias(f"cum_{c}") for c in sums))
    else:
        dealt = _dealt(held, value, keys, sizes.where(F.col("__n") > limit), parts)
        ranges = dealt.where("__part is not null").groupBy(*keys, "__part").agg(*(F.sum(c).alias(c) for c in sums))  # HOT * parts rows at most
        before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranges.select(*keys, "__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__off_{c}") for c in sums))
        by = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        summed = matched(dealt.select("*", *(F.sum(c).over(by).alias(f"__in_{c}") for c in sums)), carried, [*keys, "__part"])
        out = summed.select(*df.columns, *((F.col(f"__in_{c}") + F.coalesce(f"__off_{c}", F.lit(0))).alias(f"cum_{c}") for c in sums))
    return matched(out, sizes.drop("__n"), keys, broadcast=n.keys <= BROADCAST_KEYS).select(*shown, *(f"total_{c}" for c in sums)) if totals else out


def _dealt(df: DataFrame, value: str, keys: list[str], hot: DataFrame, parts: int) -> DataFrame:
    """df with __part: the range of a row with hot keys, null for others."""
    step = max(2, int(parts**0.5))
    some = matched(df, hot.select(*keys), keys, "left_semi") if keys else df
    found = some.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("__cuts"))
    cuts = df.sparkSession.createDataFrame(found.collect(), found.schema)  # fewer than HOT rows; cuts must not change from one reading to the next
    placed = matched(df, cuts.withColumn("__every", coarse(F.col("__cuts"), step)), keys)
    return placed.withColumn("__part", F.when(F.col("__cuts").isNotNull(), part_of(F.col(value), F.col("__cuts"), F.col("__every"), step))).drop("__cuts", "__every")


def mid_ranks(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """keys, value, n (rows with it), mid_rank: the mean rank, from 1, of the rows with each value."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running(counted, value, ["n"], list(keys))
    return ranked.select(*keys, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("mid_rank"))
