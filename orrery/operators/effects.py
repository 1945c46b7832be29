"""Effect sizes and two-sample tests: Cliff's delta with placement errors, Mann-Whitney, Welch, Kruskal-Wallis, Wilcoxon, correlations.

Values that are null or NaN take no part. A key that is null takes no part either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import mid_ranks, running

EXACT = "decimal(38,0)"


def _ties(c: Column) -> Column:
    """Sum of c^3 - c, which leaves 64 bits where some two million rows are tied."""
    c = c.cast(EXACT)
    return F.sum(c * c * c - c).cast("double").alias("ties")


def _clean(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    df = df.select(*keys, F.col(value).cast("double").alias("value"), is_a.alias("is_a"))
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("is_a").isNotNull())


def _placed(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """For each value, how many of either group have it, and have lesser ones; with the groups' sizes."""
    counted = _clean(df, keys, value, is_a).groupBy(*keys, "value").agg(F.count_if("is_a").alias("na"), F.count_if(~F.col("is_a")).alias("nb"))
    placed = running(counted, "value", ["na", "nb"], keys, totals=True).withColumnsRenamed({"total_na": "n1", "total_nb": "n2"})
    return placed.withColumns({"less_a": F.col("cum_na") - F.col("na"), "less_b": F.col("cum_nb") - F.col("nb")})


def cliff_delta(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """keys, n1, n2, delta, se, status: Cliff's delta of group a over the rest, with the standard error of its placements.

    Counts are whole numbers throughout, so that a variance is zero exactly when it should be. Without an estimate, se is
    null and status says why: non_estimable_small_group, non_estimable_degenerate_projection or
    non_estimable_zero_projection_variance. Keys with an empty group are left out.
    """
    p = _placed(df, keys, value, is_a)
    u1 = (F.col("less_b") - (F.col("n2") - F.col("less_b") - F.col("nb"))).cast(EXACT)
    u2 = (F.col("less_a") - (F.col("n1") - F.col("less_a") - F.col("na"))).cast(EXACT)
    sums = p.groupBy(*keys, "n1", "n2").agg(F.sum(F.col("na") * u1).cast(EXACT).alias("s1"), F.sum(F.col("na") * u1 * u1).cast(EXACT).alias("q1"), F.sum(F.col("nb") * u2).cast(EXACT).alias("s2"), F.sum(F.col("nb") * u2 * u2).cast(EXACT).alias("q2")).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")

    def variance(n, q, s, other):
        top = (F.col(n).cast(EXACT) * F.col(q) - F.col(s) * F.col(s)).cast("double")
        size = F.col(n).cast("double")
        return F.when(F.col(n) > 1, top / (size * (size - 1) * F.col(other).cast("double") * F.col(other).cast("double")))

    out = sums.withColumns({"delta": F.col("s1").cast("double") / (n1 * n2), "z10": variance("n1", "q1", "s1", "n2"), "z01": variance("n2", "q2", "s2", "n1")})
    flat = (F.col("z10") <= 0) & (F.col("z01") <= 0)
    status = F.when((F.col("n1") < 2) | (F.col("n2") < 2), "non_estimable_small_group").when(flat & ((F.abs("delta") >= 1) | (F.col("delta") == 0)), "non_estimable_degenerate_projection").when(flat, "non_estimable_zero_projection_variance").otherwise("ok")
    se = F.sqrt(F.col("z10") / n1 + F.col("z01") / n2)
    return out.withColumn("status", status).select(*keys, "n1", "n2", "delta", F.when(F.col("status") == "ok", se).alias("se"), "status")


def per_patient_contrasts(df: DataFrame, patient: str, value: str, is_a: Column, min_cells: int = 10) -> DataFrame:
    """patient_id, ok, n1, n2, reason, mean_a, mean_b, delta, se, se_estimable, status: Cliff's delta within each patient.

    Patients with fewer than min_cells in either group stay with ok false and their reason.
    """
    rows = _clean(df, [patient], value, is_a)
    sizes = rows.groupBy(patient).agg(F.count_if("is_a").alias("c1"), F.count_if(~F.col("is_a")).alias("c2"), F.avg(F.when(F.col("is_a"), F.col("value"))).alias("mean_a"), F.avg(F.when(~F.col("is_a"), F.col("value"))).alias("mean_b"))
    effects = cliff_delta(df, [patient], value, is_a)
    ok = (F.col("c1") >= min_cells) & (F.col("c2") >= min_cells)
    joined = sizes.join(effects, patient, "left").withColumn("ok", ok)
    shown = {c: F.when(F.col("ok"), F.col(c)).alias(c) for c in ("mean_a", "mean_b", "delta", "se", "status")}
    return joined.select(F.col(patient).alias("patient_id"), "ok", F.col("c1").alias("n1"), F.col("c2").alias("n2"), F.when(~F.col("ok"), "below_min_cells").alias("reason"), *shown.values(), F.when(F.col("ok"), F.col("status") == "ok").alias("se_estimable"))


def estimable(contrasts: DataFrame) -> DataFrame:
    return contrasts.where("ok and se_estimable")


def mann_whitney(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """keys, n1, n2, u, ties (sum of t^3 - t), auc, delta: the Mann-Whitney statistic of group a."""
    p = _placed(df, keys, value, is_a)
    t = F.col("na") + F.col("nb")
    out = p.groupBy(*keys, "n1", "n2").agg(F.sum(F.col("na") * (F.col("less_b") + F.col("nb") / F.lit(2.0))).alias("u"), _ties(t)).where("n1 > 0 and n2 > 0")
    pairs = F.col("n1").cast("double") * F.col("n2")
    return out.withColumns({"auc": F.col("u") / pairs, "delta": 2 * F.col("u") / pairs - 1})


def welch(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """keys, n1, n2, mean1, mean2, t, df: Welch's statistic and degrees of freedom; null where a variance is not defined or both are zero."""
    rows = _clean(df, keys, value, is_a)
    a, b = F.when(F.col("is_a"), F.col("value")), F.when(~F.col("is_a"), F.col("value"))
    m = rows.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"), (F.try_divide(F.var_samp(a), F.count(a))).alias("v1"), (F.try_divide(F.var_samp(b), F.count(b))).alias("v2"))
    both = F.col("v1") + F.col("v2")
    freedom = F.try_divide(both * both, F.try_divide(F.col("v1") * F.col("v1"), F.col("n1") - 1) + F.try_divide(F.col("v2") * F.col("v2"), F.col("n2") - 1))
    return m.select(*keys, "n1", "n2", "mean1", "mean2", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(both)).alias("t"), freedom.alias("df"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h, df, n: the Kruskal-Wallis statistic with tie correction, over the groups of the whole table."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("g").isNotNull())
    # counts of each group's values meet their ranks, so that a value that many rows have is no large key
    ranked = rows.groupBy("g", "value").agg(F.count("*").alias("c")).join(mid_ranks(rows, "value").select("value", "mid_rank"), "value")
    groups = ranked.groupBy("g").agg(F.sum(F.col("c") * F.col("mid_rank")).alias("s"), F.sum("c").alias("n"))
    ties = rows.groupBy("value").count().agg(_ties(F.col("count")))
    total = groups.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), (F.count("*") - 1).alias("df")).crossJoin(ties)
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return total.select(F.try_divide(h, 1 - F.col("ties") / (n * n * n - n)).alias("h"), "df", "n")


def wilcoxon(df: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """keys, n, w_plus, w_minus, ties: signed ranks of the differences that are not zero."""
    d = df.select(*keys, (F.col(one).cast("double") - F.col(two).cast("double")).alias("d")).where("d is not null and d <> 0").withColumn("size", F.abs("d"))
    counted = d.groupBy(*keys, "size").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = counted.join(mid_ranks(d, "size", keys).select(*keys, "size", "mid_rank"), [*keys, "size"])
    tied = counted.groupBy(*keys).agg(_ties(F.col("c")))
    sums = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("mid_rank")).alias("w_plus"), F.sum((F.col("c") - F.col("up")) * F.col("mid_rank")).alias("w_minus"))
    return sums.join(tied, keys) if keys else sums.crossJoin(tied)


def pearson(df: DataFrame, one: str, two: str) -> DataFrame:
    return df.select(F.col(one).cast("double").alias("x"), F.col(two).cast("double").alias("y")).where("x is not null and y is not null").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, one: str, two: str) -> DataFrame:
    """rho, n: Pearson's correlation of mid-ranks."""
    rows = df.select(F.col(one).cast("double").alias("x"), F.col(two).cast("double").alias("y")).where("x is not null and y is not null")
    counted = rows.groupBy("x", "y").agg(F.count("*").alias("c"))
    ranks = [mid_ranks(rows, v).select(v, F.col("mid_rank").alias(f"r{v}")) for v in ("x", "y")]
    ranked = counted.join(ranks[0], "x").join(ranks[1], "y").crossJoin(F.broadcast(rows.agg(((F.count("*") + 1) / F.lit(2.0)).alias("mean"))))
    rx, ry, c = F.col("rx") - F.col("mean"), F.col("ry") - F.col("mean"), F.col("c")
    return ranked.agg(F.try_divide(F.sum(c * rx * ry), F.sqrt(F.sum(c * rx * rx)) * F.sqrt(F.sum(c * ry * ry))).alias("rho"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def directions(effects: DataFrame, value: str = "delta") -> DataFrame:
    """Effects above, below and at zero, each counted on its own; a share of none is null."""
    d = F.col(value)
    return effects.agg(F.count_if(d > 0).alias("n_positive"), F.count_if(d < 0).alias("n_negative"), F.count_if(d == 0).alias("n_zero"), F.count(d).alias("n_total"), F.try_divide(F.count_if(d > 0).cast("double"), F.count(d)).alias("fraction_positive"))


def same_direction(effects: DataFrame, pooled: DataFrame, value: str = "delta") -> DataFrame:
    """How many effects have the sign of the pooled one."""
    joined = effects.crossJoin(pooled.select(F.col(value).alias("pooled")))  # pooled is one row
    return joined.agg(F.count_if(F.signum(value) == F.signum("pooled")).alias("n_same"), F.count(value).alias("n_total"))


def arm_auc(df: DataFrame, arm: str, value: str, responded: Column) -> DataFrame:
    """arm, n_r, n_nr, mean_r, mean_nr, auc_r, auc_nr, auc_best, direction of a biomarker within each treatment arm."""
    u = mann_whitney(df, [arm], value, responded)
    w = welch(df, [arm], value, responded).select(arm, F.col("mean1").alias("mean_r"), F.col("mean2").alias("mean_nr"))
    return u.join(w, arm).select(arm, F.col("n1").alias("n_r"), F.col("n2").alias("n_nr"), "mean_r", "mean_nr", "u", F.col("auc").alias("auc_r"), (1 - F.col("auc")).alias("auc_nr"), F.greatest("auc", 1 - F.col("auc")).alias("auc_best"), F.when(F.col("auc") >= 0.5, "R>NR").otherwise("NR>R").alias("direction"))
