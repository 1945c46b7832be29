import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import effects, meta, order, ranks

# Running totals


@pytest.fixture(scope="module")
def hot(spark):
    """k, v, na, nb: one key has nine tenths of 60,000 distinct values; null is a key too."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, 7).when(F.col("id") % 20 == 0, F.col("id") % 11).alias("k"), F.exp(F.randn(3) * 4).alias("v"), (F.col("id") % 5).alias("na"), (F.col("id") % 3).alias("nb"))
    return rows.persist()


def test_split_totals_are_the_window_s(spark, hot):
    whole = ranks.running(hot, "v", ["na", "nb"], ["k"], totals=True)
    split = ranks.running(hot, "v", ["na", "nb"], ["k"], totals=True, small=500)
    assert split.columns == whole.columns and split.exceptAll(whole).count() == 0 and split.count() == 60_000
    alone = ranks.running(hot.drop("k"), "v", ["na"], small=500)
    assert alone.exceptAll(ranks.running(hot.drop("k"), "v", ["na"])).count() == 0


def test_no_task_gets_much_of_a_hot_key(spark, hot):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = ranks.running(hot, "v", ["na"], ["k"], small=500)
        tasks = max(r.n for r in split.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max("cum_na")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks <= 60_000 / 32


def test_effects_of_hot_patients_are_the_same(spark, hot, monkeypatch):
    rows = hot.select("k", F.round("v", 1).alias("v"), (F.hash("v") % 3 == 0).alias("a"))
    keyed = lambda df: {r.k: r for r in df.collect()}
    before = [keyed(f(rows, ["k"], "v", F.col("a"))) for f in (effects.cliff_delta, effects.mann_whitney)]
    monkeypatch.setattr(ranks.running, "__defaults__", ((), False, 64, 300))
    after = [keyed(f(rows, ["k"], "v", F.col("a"))) for f in (effects.cliff_delta, effects.mann_whitney)]
    assert before == after and len(before[0]) > 5


def test_cuts_are_counted_in_two_steps(spark):
    rng = np.random.default_rng(0)
    cuts = sorted(set(np.round(rng.standard_normal(90), 2).tolist()))
    values = [*np.round(rng.standard_normal(300), 2).tolist(), *cuts]
    for step in (2, 7, 9, 200):
        every = ranks.coarse(F.col("c"), step)
        got = spark.createDataFrame([(v, cuts) for v in values], "v double, c array<double>").select("v", ranks.part_of(F.col("v"), F.col("c"), every, step).alias("p")).collect()
        assert all(r.p == sum(c < r.v for c in cuts) for r in got)


# Order statistics


KINDS = {
    "ties": lambda c: F.floor(F.rand(5) * 4).cast("double"),
    "tails": lambda c: F.when(c % 50 == 0, F.lit(float("nan"))).otherwise(F.signum(F.randn(1)) * F.exp(F.randn(2) * 40)),
    "constant": lambda c: F.lit(2.5),
    "one mass": lambda c: F.when(c % 3 == 0, F.rand(4)).otherwise(0.25),
    "nulls": lambda c: F.when(c % 4 > 0, F.randn(8)),
    "infinite": lambda c: F.when(c % 40 == 0, float("inf")).when(c % 40 == 1, float("-inf")).otherwise(F.randn(9)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_percentiles_are_those_of_spark(spark, monkeypatch, kind):
    monkeypatch.setattr(order, "SAMPLE", 600)
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    rows = spark.range(12_000).select(F.when(F.col("id") < 9000, 1).when(F.col("id") < 11_900, F.lit(None)).otherwise(F.col("id") % 3).alias("g"), KINDS[kind](F.col("id")).alias("x")).persist()
    for keys in ([], ["g"]):
        expected = rows.groupBy(*keys).agg(F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).collect()
        got = order.percentiles(rows, "x", probs, keys, small=100).collect()
        assert sorted(map(str, got)) == sorted(map(str, expected))


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "g int, x double")
    assert order.percentiles(none, "x", [0.5], ["g"]).collect() == [] and [r.q for r in order.percentiles(none, "x", [0.5]).collect()] == [None]
    assert [(r.g, r.q) for r in order.percentiles(spark.createDataFrame([(1, None)], "g int, x double"), "x", [0.5], ["g"]).collect()] == [(1, None)]


# Bootstrap by counts


def test_split_draws_keep_their_totals():
    counts = np.array([3, 0, 50, 1, 0, 7, 20])
    cum = np.concatenate([[0], np.cumsum(counts)])
    draws = np.stack([meta._split(np.full(20_000, 81), cum, p, (1, 0)) for p in range(7)])
    assert (draws.sum(axis=0) == 81).all() and not draws[[1, 4]].any()
    share = counts / 81
    cov = 81 * (np.diag(share) - np.outer(share, share))
    assert np.abs(draws.mean(axis=1) - counts).max() < 0.15 and np.abs(np.cov(draws) - cov).max() < 0.03 * 81


def test_weighing_is_that_of_all_pairs(monkeypatch):
    monkeypatch.setattr(meta, "SLICE", 3)
    rng = np.random.default_rng(6)
    for _ in range(30):
        na, nb = rng.integers(0, 5, 8), rng.integers(0, 5, 8)
        na[0], nb[3] = 1, 1
        drawn = []

        def kept(random, total, counts, inner=meta._shared, drawn=drawn):
            drawn.append(inner(random, total, counts))
            return drawn[-1]

        with monkeypatch.context() as m:
            m.setattr(meta, "_shared", kept)
            twice = meta._weighed(na, nb, np.full(4, na.sum()), np.full(4, nb.sum()), np.random.default_rng(1))
        a, b = np.hstack(drawn[2::2]), np.hstack(drawn[3::2])
        assert (a.sum(axis=1) == na.sum()).all() and (b.sum(axis=1) == nb.sum()).all()
        for r in range(4):
            assert twice[r] == sum(int(a[r, i] * b[r, j]) * (2 if j < i else j == i) for i, j in itertools.product(range(8), range(8)))


@pytest.mark.parametrize("size", [1 << 16, 4])
def test_moments_against_theory(spark, monkeypatch, size):
    monkeypatch.setattr(meta, "RANGE", size)
    a, b, times = [1, 2, 2, 3, 5, 8, 8, 13], [0, 2, 3, 3, 4, 9, 7], 6000
    rows = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True), (float("nan"), False), (1.0, None)], "v double, a boolean")
    got = meta.bootstrap_cliff_counts(rows, "v", F.col("a"), times, 3).toPandas()
    s = np.sign(np.subtract.outer(a, b))
    delta, by_a, by_b = s.mean(), (s.mean(axis=1) ** 2).mean(), (s.mean(axis=0) ** 2).mean()
    n, m = s.shape
    var = (by_a - delta**2) / n + (by_b - delta**2) / m + ((s**2).mean() - by_a - by_b + delta**2) / (n * m)
    assert sorted(got.replicate) == list(range(times)) and abs(got.delta.mean() - delta) < 4 * (var / times) ** 0.5
    assert abs(got.delta.var() / var - 1) < 0.08
    assert (meta.bootstrap_cliff_counts(rows, "v", F.col("a"), times, 3).toPandas().sort_values("replicate").delta.values == got.sort_values("replicate").delta.values).all()


def test_many_rows_cost_no_row_each(spark):
    rows = spark.range(3_000_000).select((F.col("id") % 100_000).cast("double").alias("v"), (F.col("id") % 7 < 3).alias("a"))
    plan = meta.bootstrap_cliff_counts(rows, "v", F.col("a"), 50)
    got = plan.toPandas()
    assert len(got) == 50 and 1e-6 < got.delta.std() < 2e-3 and abs(got.delta.mean()) < 2e-3
    assert "Explode" not in plan._jdf.queryExecution().toString()


def test_without_a_group(spark):
    assert meta.bootstrap_cliff_counts(spark.createDataFrame([(1.0, True)], "v double, a boolean"), "v", F.col("a")).collect() == []


def test_hashed_replicates_make_no_row_for_a_draw(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 50 == 1 else math.nan if i % 40 == 2 else float(rng.integers(0, 60)), None if i % 70 == 3 else bool(i % 3 == 0)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, v double, a boolean").repartition(3)
    counted, joined = (meta.bootstrap_cliff(df, "id", "v", F.col("a"), 20, 3, most) for most in (meta.PACKED, 0))
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()
    one, two = ({r.replicate: r.delta for r in x.collect()} for x in (counted, joined))
    assert one == pytest.approx(two, abs=1e-12) and len(one) == 20 and len(set(one.values())) > 1
    assert meta.bootstrap_cliff(df.where("a"), "id", "v", F.col("a"), 5).count() == 0
