"""Exact percentiles of any number of groups, whatever their size, by counting over shrinking ranges of values.

Spark's percentile holds all distinct values of a group in one buffer. Here only groups up to SMALL values go that way. Of the
others, all ranks of all groups that are asked for are narrowed together: a round takes cuts from a sample of each range in
question, counts exactly how many values lie between the cuts and at them, and keeps for each rank the gap it lies in, or the
cut itself where the rank falls on it. A round divides a range by some CUTS; what is left of it at last is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .ranks import coarse, matched, part_of

#: Values of a group, or of a range, that are brought together; cuts of a range, and values sampled for them on average.
SMALL, CUTS, SAMPLE = 1 << 16, 255, 1 << 14
#: Ranges that are broadcast at most, each with its cuts.
BROADCAST_RANGES = 2_000


def _between(lo: str = "lo", hi: str = "hi"):
    v = F.col("__v")
    return (F.col(lo).isNull() | (v > F.col(lo))) & (F.col(hi).isNull() | (v < F.col(hi)))


def _narrowed(held: DataFrame, keys: list[str], ranges: DataFrame, number: int, turn: int) -> DataFrame:
    """keys, rank, value, lo, hi, below, inside: the rank's value where it is found, else the range that is left of it."""
    few = number <= BROADCAST_RANGES
    sampled = matched(held, ranges.select(*keys, "lo", "hi", "inside"), keys, "inner", few, _between())
    sampled = sampled.where(F.rand(turn) * F.col("inside") < SAMPLE)
    grid = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    cuts = sampled.groupBy(*keys, F.col("lo").alias("lo_"), F.col("hi").alias("hi_")).agg(F.array_distinct(F.percentile("__v", F.array(*map(F.lit, grid)))).alias("cuts"))
    step = int((CUTS + 1) ** 0.5)
    cuts = pinned(cuts.withColumn("every", coarse(F.col("cuts"), step)), "cuts")
    with_cuts = matched(ranges, cuts, keys, "left", few, F.col("lo").eqNullSafe(F.col("lo_")) & F.col("hi").eqNullSafe(F.col("hi_"))).drop("lo_", "hi_")
    with_cuts = with_cuts.withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in ("cuts", "every")})  # of an empty sample
    part = part_of(F.col("__v"), F.col("cuts"), F.col("every"), step)
    placed = matched(held, with_cuts.select(*keys, "lo", "hi", "cuts", "every"), keys, "inner", few, _between()).withColumn("part", part)
    # odd places are cuts, even ones the gaps before them
    place = 2 * F.col("part") + F.coalesce((F.get(F.col("cuts"), F.col("part")) == F.col("__v")).cast("int"), F.lit(0))
    counted = pinned(placed.groupBy(*keys, F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), place.alias("place")).agg(F.count("*").alias("c")), "counts")
    before = Window.partitionBy(*keys, "lo_", "hi_").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # 2 * CUTS + 1 rows at most
    cum = counted.withColumn("cum", F.sum("c").over(before))
    asked = with_cuts.withColumn("rank", F.explode("ranks"))
    here = F.col("lo").eqNullSafe(F.col("lo_")) & F.col("hi").eqNullSafe(F.col("hi_")) & (F.col("rank") - F.col("below") < F.col("cum")) & (F.col("rank") - F.col("below") >= F.col("cum") - F.col("c"))
    found = matched(asked, cum, keys, "inner", False, here)
    at = F.expr("cast(floor(place / 2) as int)")
    return found.select(
        *keys, "rank", F.when(F.col("place") % 2 == 1, F.get("cuts", at)).alias("value"), F.when(at > 0, F.get("cuts", at - 1)).otherwise(F.col("lo")).alias("lo"), F.coalesce(F.get("cuts", at), F.col("hi")).alias("hi"),
        (F.col("below") + F.col("cum") - F.col("c")).alias("below"), F.col("c").alias("inside"),
    )


def order_statistics(held: DataFrame, keys: list[str], asked: DataFrame, small: int = SMALL) -> DataFrame:
    """keys, rank, value: the value of each rank, from 0, that is asked for (keys, n, ranks), among held (keys, __v) without nulls."""
    ranges = pinned(asked.select(*keys, F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "ranks"), "ranges")
    done, turn = None, 0
    while True:
        left = ranges.agg(F.count("*").alias("n"), F.max("inside").alias("most")).first()
        if (left.most or 0) <= small:
            break
        turn += 1
        large = F.col("inside") > small
        step = pinned(_narrowed(held, keys, ranges.where(large), left.n, turn), "ranks")
        found = step.where("value is not null").select(*keys, "rank", "value")
        done = found if done is None else done.unionByName(found)
        again = step.where("value is null").groupBy(*keys, "lo", "hi", "below", "inside").agg(F.collect_list("rank").alias("ranks"))
        ranges = pinned(again.unionByName(ranges.where(~large)), "ranges")
    rows = matched(held, ranges, keys, "inner", left.n <= BROADCAST_RANGES, _between())
    sorted_ = rows.groupBy(*keys, "lo", "hi", "below", "ranks").agg(F.sort_array(F.collect_list("__v")).alias("v"))  # small values at most
    last = sorted_.select(*keys, "below", "v", F.explode("ranks").alias("rank")).select(*keys, "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    return last if done is None else done.unionByName(last)


def percentiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """keys, q: for each group the exact percentiles of value, linear between neighbours, as Spark's percentile gives them.

    Nulls are left out, and a group of nulls has a null q; NaN is the largest value. Null keys are a group. Without keys there is
    one row, for an empty table too.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    held = pinned(df.select(*keys, F.col(value).cast("double").alias("__v")), "values")
    sizes = held.groupBy(*keys).agg(F.count("__v").alias("n"))
    plain = F.percentile("__v", F.array(*map(F.lit, probs))).alias("q")
    n = sizes.agg(F.max("n").alias("most"), F.count_if(F.col("n") > small).alias("large")).first()
    if (n.most or 0) <= small:
        return held.groupBy(*keys).agg(plain)
    large = pinned(sizes.where(F.col("n") > small), "large")
    few = n.large <= BROADCAST_RANGES
    places = F.array(*map(F.lit, probs))
    at = F.transform(places, lambda p: p * (F.col("n") - 1))
    asked = large.withColumn("ranks", F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x)))))
    rows = held.where(F.col("__v").isNotNull())
    some = matched(rows, large.select(*keys), keys, "left_semi", few) if keys else rows
    ranked = order_statistics(some, keys, asked, small)
    both = matched(ranked, large, keys, "inner", few).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("by"))  # two for each of probs

    def one(p):
        x = p * (F.col("n") - 1)
        low, high = F.element_at("by", F.floor(x)), F.element_at("by", F.ceil(x))
        return F.when((F.floor(x) == F.ceil(x)) | (low == high), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    out = both.select(*keys, F.transform(places, one).alias("q"))
    if not keys:
        return out
    return out.unionByName(matched(held, large.select(*keys), keys, "left_anti", few).groupBy(*keys).agg(plain))
