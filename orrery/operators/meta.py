"""Random-effects meta-analysis: DerSimonian-Laird with its sensitivity interval, bootstraps, and the decisions made on pooled effects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import tails
from ..functions.scalars import draw_index
from ..session import pinned
from .ranks import coarse, part_of, running

CRITICAL = 1.96


def check_effects(effects: DataFrame, delta: str = "delta", se: str = "se") -> DataFrame:
    """effects as they are; reading them raises an error if an effect lies outside [-1, 1] or an error is not positive. Rows are never dropped."""
    d, s = F.col(delta).cast("double"), F.col(se).cast("double")
    good = d.isNotNull() & s.isNotNull() & ~F.isnan(d) & ~F.isnan(s) & (F.abs(d) <= 1 + 1e-12) & (s > 0) & (s < F.lit(float("inf")))
    return effects.withColumns({delta: F.when(good, d).otherwise(F.raise_error(F.lit("effects must lie in [-1, 1] with positive errors")).cast("double")), se: s})


def dersimonian_laird(effects: DataFrame, keys: list[str] = (), delta: str = "delta", se: str = "se") -> DataFrame:
    """keys, k, delta, se, ci_lo, ci_hi, z, q, df, tau2, i2, delta_fe, hk_se: studies pooled within each group of keys.

    A single study has null q, tau2, i2 and hk_se. hk_se is the Hartung-Knapp error with a scale of 1 at least.
    """
    keys = list(keys)
    one = F.struct(F.col(delta).cast("double").alias("d"), F.col(se).cast("double").alias("s"))
    studies = effects.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("e")).where(F.size("e") > 0)  # studies of a pool, not cells

    def total(f) -> Column:
        return F.aggregate("e", F.lit(0.0), lambda acc, x: acc + f(x))

    def w(x) -> Column:
        return 1 / (x["s"] * x["s"])

    def ws(x) -> Column:
        return 1 / (x["s"] * x["s"] + F.col("tau2_used"))

    k, free, many = F.col("k"), F.col("k") - 1, F.col("k") > 1
    sums = studies.select(*keys, "e", F.size("e").cast("long").alias("k"), total(w).alias("sw"), total(lambda x: w(x) * w(x)).alias("sww"), total(lambda x: w(x) * x["d"]).alias("swd"))
    fixed = sums.withColumn("delta_fe", F.col("swd") / F.col("sw"))
    spread = fixed.withColumn("q0", total(lambda x: w(x) * (x["d"] - F.col("delta_fe")) * (x["d"] - F.col("delta_fe"))))
    c = F.col("sw") - F.col("sww") / F.col("sw")
    spread = spread.withColumn("tau2_used", F.when(many & (c > 0), F.greatest(F.lit(0.0), F.try_divide(F.col("q0") - free, c))).otherwise(0.0))
    pooled = spread.withColumn("sws", total(ws)).withColumn("re", total(lambda x: ws(x) * x["d"]) / F.col("sws"))
    pooled = pooled.withColumn("r", total(lambda x: ws(x) * (x["d"] - F.col("re")) * (x["d"] - F.col("re")))).withColumn("rse", F.sqrt(1 / F.col("sws")))
    return pooled.select(
        *keys, k.alias("k"), F.col("re").alias("delta"), F.col("rse").alias("se"), (F.col("re") - CRITICAL * F.col("rse")).alias("ci_lo"), (F.col("re") + CRITICAL * F.col("rse")).alias("ci_hi"), (F.col("re") / F.col("rse")).alias("z"),
        F.when(many, F.col("q0")).alias("q"), free.alias("df"), F.when(many, F.col("tau2_used")).alias("tau2"),
        F.when(many, F.when(F.col("q0") > 0, F.greatest(F.lit(0.0), F.try_divide(F.col("q0") - free, F.col("q0"))) * 100).otherwise(0.0)).alias("i2"),
        "delta_fe", F.when(many, F.sqrt(F.greatest(F.lit(1.0), F.try_divide(F.col("r"), free)) / F.col("sws"))).alias("hk_se"),
    )


def with_tails(pooled: DataFrame) -> DataFrame:
    """pooled with p, log_p, one_sided_p, p_q, log_p_q and the Hartung-Knapp interval and p."""
    t = tails.t_quantile(0.975, F.when(F.col("df") > 0, F.col("df")))
    free = F.when(F.col("df") > 0, F.col("df"))
    return pooled.withColumns({"p": tails.two_sided_normal("z"), "log_p": tails.two_sided_normal_log("z"), "one_sided_p": tails.normal_sf("z"), "p_q": tails.chi_squared_sf(F.col("q"), free), "log_p_q": tails.chi_squared_logsf(F.col("q"), free), "hk_lo": F.col("delta") - t * F.col("hk_se"), "hk_hi": F.col("delta") + t * F.col("hk_se"), "hk_p": tails.two_sided_t(F.col("delta") / F.col("hk_se"), free)})


def bootstrap_pooled(effects: DataFrame, id_col: str, b: int = 1000, seed: int = 0, stage: str = "bootstrap-dl") -> DataFrame:
    """replicate, delta: studies drawn with replacement and pooled, b times. Draws are hashes, the same on every engine."""
    numbered = effects.select(F.col(id_col).alias("id"), "delta", "se").withColumn("i", F.row_number().over(Window.orderBy("id")) - 1)  # studies, not rows: a small table
    k = numbered.agg(F.count("*").alias("k"))
    draws = effects.sparkSession.range(b).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(k)).select("replicate", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("j"))
    drawn = draws.select("replicate", draw_index(seed, stage, F.col("k"), F.col("replicate"), F.col("j")).alias("i")).join(F.broadcast(numbered), "i")
    return dersimonian_laird(drawn, ["replicate"]).select("replicate", "delta")


def interval(replicates: DataFrame, value: str = "delta", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return replicates.agg(F.count("*").alias("b"), F.avg(value).alias("mean"), F.percentile(value, F.lit(tail)).alias("ci_lo"), F.percentile(value, F.lit(1 - tail)).alias("ci_hi"))


#: Rows up to which each task of a bootstrap holds the places of all values, 4 bytes a row; draws that it makes at once.
PACKED, DRAWS = 1 << 25, 1 << 16


def bootstrap_cliff(df: DataFrame, id_col: str, value: str, is_a: Column, b: int = 400, seed: int = 0, most: int = PACKED) -> DataFrame:
    """replicate, delta: both groups drawn with replacement, b times, for a table of one contrast's rows.

    Up to `most` rows a task makes a replicate's draws, the hashes of draw_index, and counts them by value: no row is made for a
    draw. More rows are drawn and ranked by joins. Rows without a value or a group take no part; NaN is drawn, but not compared.
    """
    from .effects import mann_whitney

    rows = df.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("value"), is_a.alias("arm"), F.lit(1).alias("one")).where("value is not null and arm is not null")
    if isinstance(rows.schema["id"].dataType, NumericType):
        placed = running(rows, "id", ["one"], ["arm"]).select("arm", (F.col("cum_one") - 1).cast("long").alias("i"), "value")
    else:
        placed = rows.select("arm", (F.row_number().over(Window.partitionBy("arm").orderBy("id")) - 1).cast("long").alias("i"), "value")
    numbered = pinned(placed, "numbered")
    sizes = numbered.groupBy("arm").agg(F.count("*").alias("n"))
    n = {r.arm: r.n for r in sizes.collect()}  # two rows
    if len(n) == 2 and sum(n.values()) <= most:
        return _counted_replicates(numbered, n, b, seed)
    draws = df.sparkSession.range(b).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(sizes)).select("replicate", "arm", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j"))
    drawn = draws.select("replicate", "arm", draw_index(seed, "bootstrap-cliff", F.col("n"), F.col("replicate"), F.col("arm"), F.col("j")).alias("i")).join(numbered.select("arm", "i", "value"), ["arm", "i"])
    return mann_whitney(drawn, ["replicate"], "value", F.col("arm")).select("replicate", "delta")


def _counted_replicates(numbered: DataFrame, n: dict[bool, int], b: int, seed: int) -> DataFrame:
    """replicate, delta of rows (arm, i, value), n of them in each arm; every task holds the place of each row's value."""
    spark = numbered.sparkSession
    levels = pinned(running(numbered.where(~F.isnan("value")).select("value").distinct().withColumn("one", F.lit(1)), "value", ["one"]).select("value", F.col("cum_one").cast("int").alias("at")), "levels")
    many = levels.count()
    at = numbered.join(levels, "value", "left").select("arm", "i", F.coalesce("at", F.lit(0)).alias("at"))  # NaN is 0
    blocks = at.groupBy("arm", F.floor(F.col("i") / DRAWS).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "at"))), lambda e: e["at"]).alias("at"))
    places = {arm: np.empty(size, np.int32) for arm, size in n.items()}
    for r in blocks.toArrow().to_batches(max_chunksize=16):
        for arm, block, flat in zip(r["arm"].to_pylist(), r["block"].to_pylist(), r["at"]):
            places[arm][block * DRAWS : (block + 1) * DRAWS] = flat.values.to_numpy()
    held = spark.sparkContext.broadcast(places)

    def counted(replicate: int, arm: bool) -> np.ndarray:
        """How often each value is drawn, in rising order."""
        at, head = held.value[arm], f"{seed}:bootstrap-cliff:{replicate}:{str(arm).lower()}:".encode()
        out = np.zeros(many + 1, np.int32)
        for start in range(0, len(at), DRAWS):
            heads = b"".join([hashlib.md5(head + b"%d" % j).digest()[:4] for j in range(start, min(start + DRAWS, len(at)))])
            np.add.at(out, at[np.frombuffer(heads, ">u4").astype(np.int64) % len(at)], 1)
        return out[1:].astype(np.int64)

    def deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for replicate in batch.column(0).to_pylist():
                a, o = counted(replicate, True), counted(replicate, False)
                pairs = float(a.sum()) * float(o.sum())
                if pairs:
                    twice = float((a * (2 * (np.cumsum(o) - o) + o)).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([replicate], pa.int64()), pa.array([twice / pairs - 1])], names=["replicate", "delta"])

    return spark.range(0, b, 1, b).mapInArrow(deltas, "replicate long, delta double")


#: Distinct values of a range that a task weighs, and of a slice of it whose weights it holds at once for all replicates.
RANGE, SLICE = 1 << 16, 1 << 10


def _split(total: np.ndarray, cum: np.ndarray, at: int, seed: tuple[int, ...]) -> np.ndarray:
    """Draws that fall into range `at`, for each replicate's total of draws over all ranges, cum the running counts of the ranges:
    binomial draws down a tree over the ranges, each node's from its own seed, so that all tasks see the same tree."""
    lo, hi = 0, len(cum) - 1
    while hi - lo > 1:
        mid, mass = (lo + hi) // 2, int(cum[hi] - cum[lo])
        share = int(cum[mid] - cum[lo]) / mass if mass else 0.0
        left = np.random.default_rng([*seed, lo, hi]).binomial(total, share)
        lo, hi, total = (lo, mid, left) if at < mid else (mid, hi, total - left)
    return total


def _shared(random: np.random.Generator, total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each replicate's total, split by multinomial draws in proportion to counts: (replicates, counts)."""
    mass = counts.sum()
    return random.multinomial(total, counts / mass) if mass else np.zeros((len(total), len(counts)), np.int64)


def _weighed(na: np.ndarray, nb: np.ndarray, wa: np.ndarray, wb: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """For values in rising order with counts na, nb in the groups, and each replicate's draws wa, wb among them: twice the sum
    over pairs of draws of whether b's is below a's, halves for ties."""
    exact = object if float(wa.max(initial=0)) * float(wb.max(initial=0)) > float(1 << 60) else np.int64
    starts = np.arange(0, len(na), SLICE)
    pa_, pb = (_shared(random, w, np.add.reduceat(n, starts)) for w, n in ((wa, na), (wb, nb)))
    twice, below = np.zeros(len(wa), exact), np.zeros(len(wa), exact)
    for k, s in enumerate(starts):
        a, b = (_shared(random, w[:, k], n[s : s + SLICE]).astype(exact) for w, n in ((pa_, na), (pb, nb)))
        seen = np.cumsum(b, axis=1)
        twice = twice + (a * (2 * (seen - b + below[:, None]) + b)).sum(axis=1)
        below = below + seen[:, -1]
    return twice


def bootstrap_cliff_counts(df: DataFrame, value: str, is_a: Column, b: int = 400, seed: int = 0) -> DataFrame:
    """replicate, delta: both groups drawn with replacement, b times, without a row for a draw.

    How often a replicate draws a value is multinomial, so that it is drawn by splitting: the replicate's draws over ranges of
    values by a tree of binomials, those of a range over its distinct values. A task weighs a range's values for all replicates
    and gives one row for each of these; so a replicate costs distinct values, and shuffles ranges. Null and NaN values take no
    part; without a row in either group there are no replicates. The same table and seed give the same draws.
    """
    rows = df.select(F.col(value).cast("double").alias("value"), is_a.alias("a")).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("a").isNotNull())
    counted = pinned(rows.groupBy("value").agg(F.count_if("a").alias("na"), F.count_if(~F.col("a")).alias("nb")), "values")
    n = counted.agg(F.count("*").alias("d"), F.coalesce(F.sum("na"), F.lit(0)).alias("a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("b")).first()
    if not n.a or not n.b:
        return df.sparkSession.createDataFrame([], "replicate long, delta double")
    ranges = -(-n.d // RANGE)
    cuts = counted.agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts))
    every, step = F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), max(2, int(len(cuts) ** 0.5))
    dealt = counted.withColumn("part", part_of(F.col("value"), every, coarse(every, step), step))
    sizes = {r.part: (r.a, r.b) for r in dealt.groupBy("part").agg(F.sum("na").alias("a"), F.sum("nb").alias("b")).collect()}  # a row a range
    cum = np.concatenate([[[0, 0]], np.cumsum([sizes.get(p, (0, 0)) for p in range(len(cuts) + 1)], axis=0)]).astype(np.int64)

    def weighed(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        part, t = key[0].as_py(), t.sort_by("value")
        wa, wb = (_split(np.full(b, cum[-1, i]), cum[:, i], part, (seed, i)) for i in (0, 1))
        twice = _weighed(t["na"].to_numpy(), t["nb"].to_numpy(), wa, wb, np.random.default_rng([seed, 2, part]))
        wide = pa.decimal128(38, 0)
        return pa.table({"part": pa.array([part] * b, pa.int32()), "replicate": pa.array(range(b), pa.int64()), "wa": pa.array(wa.tolist(), wide), "wb": pa.array(wb.tolist(), wide), "twice": pa.array([int(x) for x in twice], wide)})

    made = dealt.groupBy("part").applyInArrow(weighed, "part int, replicate long, wa decimal(38,0), wb decimal(38,0), twice decimal(38,0)")
    before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = made.withColumn("below", F.coalesce(F.sum("wb").over(before), F.lit(0)).cast("decimal(19,0)"))
    sums = below.groupBy("replicate").agg(F.sum(F.col("twice").cast("double") + 2.0 * F.col("wa").cast("double") * F.col("below").cast("double")).alias("twice"))
    return sums.select("replicate", (F.col("twice") / (float(n.a) * float(n.b)) - 1).alias("delta"))


def protocol_decision(pooled: DataFrame, checks_passed: bool = True, donors_verified: bool = True, parameters_match: bool = True, minimum: int = 5) -> DataFrame:
    """pooled with status, supported: whether the effect is above zero at one-sided 5 %, or why that cannot be said."""
    valid = all((checks_passed, donors_verified, parameters_match))
    good = F.col("delta").between(-1, 1) & F.col("one_sided_p").between(0, 1) & ~F.isnan("delta")
    status = F.when(~F.lit(valid), "INVALID_ANALYSIS").when(F.col("k").isNull() | (F.col("k") < minimum), "INSUFFICIENT_PATIENTS").when(~F.coalesce(good, F.lit(False)), "INVALID_NUMERICS").when((F.col("delta") > 0) & (F.col("one_sided_p") < 0.05), "SUPPORTED").otherwise("NOT_SUPPORTED")
    return pooled.withColumn("status", status).withColumn("supported", F.when(F.col("status").isin("SUPPORTED", "NOT_SUPPORTED"), F.col("status") == "SUPPORTED"))


def label_verdict(schemes: DataFrame, expected: list[str], band: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """verdict, n_classified, n_expected, delta_min, delta_max: whether the direction holds under every labelling scheme (scheme, ok, delta, p)."""
    wanted = schemes.sparkSession.createDataFrame([(s,) for s in expected], "scheme string").join(schemes, "scheme", "left")
    usable = F.coalesce(F.col("ok") & F.col("delta").isNotNull() & F.col("p").isNotNull() & ~F.isnan("delta") & ~F.isnan("p"), F.lit(False))
    kind = F.when(usable & (F.col("delta") < -band) & (F.col("p") < alpha), "negative").when(usable & (F.col("delta") > band) & (F.col("p") < alpha), "positive").when(usable, "null")
    counts = wanted.select(kind.alias("kind"), "delta").agg(F.count("kind").alias("n_classified"), F.lit(len(expected)).alias("n_expected"), F.count_if(F.col("kind") == "negative").alias("neg"), F.count_if(F.col("kind") == "positive").alias("pos"), F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"))
    verdict = F.when(F.col("n_classified") < F.col("n_expected"), "inconclusive").when(F.col("neg") > 0, "annotation_dependent_sign_reversal").when(F.col("pos") == F.col("n_expected"), "robust_all_positive").otherwise("robust_in_direction_with_null_schemes")
    return counts.select(verdict.alias("verdict"), "n_classified", "n_expected", "delta_min", "delta_max")


def variance_by_axis(grid: DataFrame, axes: list[str], value: str) -> DataFrame:
    """axis, fraction: share of value's variance that lies between the levels of each axis of a parameter grid."""
    total = grid.agg(F.avg(value).alias("grand"), F.var_pop(value).alias("var"), F.count(value).alias("n"))
    out = None
    for axis in axes:
        means = grid.groupBy(axis).agg(F.avg(value).alias("m"), F.count(value).alias("c")).crossJoin(F.broadcast(total))
        one = means.agg((F.sum(F.col("c") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))) / F.max("n")).alias("between"), F.max("var").alias("var")).select(F.lit(axis).alias("axis"), F.try_divide("between", "var").alias("fraction"))
        out = one if out is None else out.unionByName(one)
    return out


# Bounds of the two verdicts.
STABLE_SHARE, STABLE_MEDIAN, FRAGILE_SHARE, FRAGILE_MEDIAN = 0.80, 0.30, 0.50, 0.10
WEAKENED, CONFOUNDED = 0.5, 0.2


def stability(grid: DataFrame, value: str = "delta") -> DataFrame:
    """n, share, median, verdict: whether an effect holds over a parameter grid. share is that of positive effects.

    stable: more than STABLE_SHARE are positive and the median is beyond STABLE_MEDIAN of zero; fragile: fewer than
    FRAGILE_SHARE are, or the median is within FRAGILE_MEDIAN; else partly fragile. Null effects count as no run.
    """
    counts = grid.agg(F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("n_positive"), F.percentile(value, F.lit(0.5)).alias("median"))
    share = F.try_divide(F.col("n_positive").cast("double"), F.col("n"))
    stable = (share > STABLE_SHARE) & (F.abs("median") > STABLE_MEDIAN)
    fragile = (share < FRAGILE_SHARE) | (F.abs("median") < FRAGILE_MEDIAN)
    return counts.select("n", share.alias("share"), "median", F.when(F.col("n") > 0, F.when(stable, "stable").when(fragile, "fragile").otherwise("partly fragile")).alias("verdict"))


def batch_verdict(effects: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, original, corrected, random, depth, drop, verdict, for effects (keys, method, delta) with one of these four methods;
    several random embeddings count by their mean.

    KILLED: the corrected embedding's effect has another sign; WEAKENED: its size falls by half or more; NULL-MATCHED: that of
    random embeddings is beyond CONFOUNDED; DEPTH-CONFOUNDED: that of sequencing depth alone is, with the original's sign;
    else SURVIVES. An original effect of zero has no drop.
    """
    one = effects.groupBy(*keys).agg(*(F.avg(F.when(F.col("method") == m, F.col("delta"))).alias(m) for m in ("original", "corrected", "random", "depth")))
    one = one.withColumn("drop", F.try_divide(F.abs("original") - F.abs("corrected"), F.abs("original")))
    flips = F.signum("original") != F.signum("corrected")
    verdict = F.when(flips, "KILLED").when(F.col("drop") >= WEAKENED, "WEAKENED").when(F.abs("random") > CONFOUNDED, "NULL-MATCHED")
    return one.withColumn("verdict", verdict.when((F.abs("depth") > CONFOUNDED) & (F.signum("depth") == F.signum("original")), "DEPTH-CONFOUNDED").otherwise("SURVIVES"))


def against_random(observed: DataFrame, random: DataFrame, value: str = "delta") -> DataFrame:
    """value, mean, std, z, lo, hi, inside: an effect among those of random panels."""
    r = random.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))
    return observed.select(F.col(value).alias("value")).crossJoin(F.broadcast(r)).withColumns({"z": F.try_divide(F.col("value") - F.col("mean"), F.col("std")), "inside": F.col("value").between(F.col("lo"), F.col("hi"))})
