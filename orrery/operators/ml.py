"""Classifier evaluation: splits, standardisation, balanced logistic regression, and ranking metrics."""

from __future__ import annotations

from collections.abc import Generator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import draw
from ..session import pinned
from .batches import matrix
from .ranks import running

#: Features up to which a model is fitted by Newton's method; numbers of a training table that the driver holds (8 MB).
NEWTON, LOCAL = 512, 1 << 20


def stratified_split(df: DataFrame, label: str, id_col: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with test: share of each class, rounded up, by the rows' hashes."""
    by = Window.partitionBy(label).orderBy("__h", id_col)
    sizes = df.groupBy(label).agg(F.ceil(F.count("*") * F.lit(share)).alias("__n"))
    ranked = df.withColumn("__h", draw(seed, f"split-{seed}", F.col(id_col)) if seed == 0 else draw(0, f"split-{seed}", F.col(id_col))).withColumn("__r", F.row_number().over(by))
    return ranked.join(F.broadcast(sizes), label).withColumn("test", F.col("__r") <= F.col("__n")).drop("__h", "__r", "__n")


def standardised(train: DataFrame, other: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
    """Both tables' features by the training rows' mean and population standard deviation (1 where it is 0)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    m = train.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(features)).alias("s")).select("s.*").first()
    n = m["count"]
    mean, var = m["mean"].toArray(), m["variance"].toArray() * ((n - 1) / n if n > 1 else 0)
    std = [float(v) ** 0.5 if v > 0 else 1.0 for v in var]
    z = F.zip_with(F.zip_with(features, F.array(*map(F.lit, map(float, mean))), lambda x, a: x - a), F.array(*map(F.lit, std)), lambda x, s: x / s)
    return train.withColumn(features, z), other.withColumn(features, z)


def _newton(c: float, dims: int, steps: int) -> Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], np.ndarray]:
    """Asks for loss, gradient and matrix at a point, until it gives the weights and, last, the intercept that minimise the losses plus
    half the squared weights over c."""
    penalty = np.append(np.full(dims, 1 / c), 0.0)

    def sums(at: np.ndarray):
        loss, gradient, curve = yield at
        return loss + 0.5 * float(penalty @ (at * at)), gradient + penalty * at, curve + np.diag(penalty)

    beta = np.zeros(dims + 1)
    loss, gradient, curve = yield from sums(beta)
    for _ in range(steps):
        step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
        size = 1.0
        after = yield from sums(beta - step)
        while after[0] > loss and size > 1e-6:  # a whole step can go too far
            size /= 2
            after = yield from sums(beta - size * step)
        beta = beta - size * step
        done = loss - after[0] <= 1e-12 * max(1.0, abs(loss))
        loss, gradient, curve = after
        if done:
            break
    return beta


def weights_of_runs(rows: DataFrame, c: float, dims: int, runs: list[int], steps: int = 50) -> dict[int, np.ndarray]:
    """logistic_weights of each run's rows (run, label, features, w). The runs go on together: a step of all is one job; training tables of
    up to LOCAL numbers a run are summed on the driver."""

    def partial(at: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = x @ at
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return float((w * (np.logaddexp(0, z) - y * z)).sum()), x.T @ (w * (p - y)), (x * (w * p * (1 - p))[:, None]).T @ x

    def arrays(batch: pa.RecordBatch, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = batch.filter(pa.array(batch.column(0).to_numpy() == run))
        x = matrix(some.column(2)).astype(float) if some.num_rows else np.zeros((0, dims))
        return some.column(1).to_numpy(), np.column_stack([x, np.ones(len(x))]), some.column(3).to_numpy()

    def distributed(points: dict[int, np.ndarray]) -> dict[int, tuple]:
        def made(sums: dict[int, list]) -> dict[str, pa.Array]:
            losses = pa.array([s[0] for s in sums.values()], pa.float64())
            return {"run": pa.array(list(sums), pa.int32()), "loss": losses} | {c: pa.array([s[i].tobytes() for s in sums.values()], pa.binary()) for i, c in ((1, "gradient"), (2, "curve"))}

        def added(batches):
            total: dict[int, list] = {}
            for batch in batches:
                for run in np.unique(batch.column(0).to_numpy()).tolist():
                    more = partial(points[run], *arrays(batch, run))
                    total[run] = [t + m for t, m in zip(total[run], more)] if run in total else list(more)
            out = made(total)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        def summed(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
            gradient, curve = (sum(np.frombuffer(v.as_buffer()) for v in t[c]) for c in ("gradient", "curve"))
            return pa.table(made({key[0].as_py(): [sum(t["loss"].to_pylist()), gradient, curve]}))

        kind = "run int, loss double, gradient binary, curve binary"
        parts = rows.where(F.col("run").isin(list(points))).mapInArrow(added, kind).groupBy("run").applyInArrow(summed, kind).collect()
        return {r.run: (r.loss, np.frombuffer(r.gradient), np.frombuffer(r.curve).reshape(dims + 1, dims + 1)) for r in parts}

    rows = rows.select(F.col("run").cast("int").alias("run"), "label", "features", "w")
    here = None
    if rows.count() * dims <= LOCAL * len(runs):
        table = rows.toArrow().combine_chunks().to_batches()
        here = {run: tuple(np.concatenate(parts) for parts in zip(*(arrays(batch, run) for batch in table))) for run in runs}
    found, fits = {}, {run: _newton(c, dims, steps) for run in runs}
    points = {run: next(fit) for run, fit in fits.items()}
    while points:
        sums = {run: partial(at, *here[run]) for run, at in points.items()} if here else distributed(points)
        for run in list(points):
            try:
                points[run] = fits[run].send(sums[run])
            except StopIteration as end:
                found[run] = end.value
                del points[run]
    return found


def logistic_weights(rows: DataFrame, c: float, dims: int, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept that minimise the weighted losses plus half the squared weights over c, by Newton's
    method: each step is one job that adds up a gradient and a matrix of dims x dims. rows: label (0 or 1), features, w."""
    return weights_of_runs(rows.withColumn("run", F.lit(0)), c, dims, [0], steps)[0]


def logistic_scores(train: DataFrame, test: DataFrame, label: str, features: str, c: float = 1.0) -> DataFrame:
    """test with score: class weights balanced, L2 penalty of 1 / c on the sum of losses, intercept free. Up to NEWTON features are
    fitted by Newton's method, more by Spark's own."""
    one, two = standardised(train, test, features)
    n = one.groupBy(label).agg(F.count("*").alias("count"), F.max(F.size(features)).alias("dims")).collect()
    total, dims = sum(r["count"] for r in n), max((r.dims for r in n), default=0)
    weight = reduce(lambda w, r: w.when(F.col(label) == r[label], total / (len(n) * r["count"])), n, F.when(F.lit(False), 0.0))
    # a step of the fit is a job: few tasks for few rows
    rows = one.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"), weight.alias("w")).coalesce(max(1, total // 50_000))
    if dims <= NEWTON:
        beta = logistic_weights(pinned(rows, "rows"), c, dims)
        z = F.aggregate(F.zip_with(features, F.array(*map(F.lit, beta[:-1].tolist())), lambda x, b: x * b), F.lit(float(beta[-1])), lambda s, v: s + v)
        return two.withColumn("score", 1 / (1 + F.exp(-z)))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = LogisticRegression(weightCol="w", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows.withColumn("features", array_to_vector("features")))
    scored = model.transform(two.withColumnRenamed(features, "__f").withColumn("features", array_to_vector("__f")))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("__f", features)


def _by_score(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(label).alias("p"))


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] = ()) -> DataFrame:
    """auc by mid-ranks, of each keys; null without both classes."""
    c = running(_by_score(df, label, score, keys), "s", ["n"], keys)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    s = c.groupBy(*keys).agg(F.sum(rank * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / F.lit(2.0), (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, keys: list[str] = ()) -> DataFrame:
    """ap: precision at each score, weighted by the recall it adds."""
    c = running(_by_score(df, label, score, keys).withColumn("s", -F.col("s")), "s", ["n", "p"], keys)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")), F.sum("p").cast("double")).alias("ap"))


def accuracy_f1(df: DataFrame, label: str, score: str, threshold: float = 0.5, keys: list[str] = ()) -> DataFrame:
    yes, y = F.col(score) >= threshold, F.col(label)
    hit, miss = F.count_if(yes & y), F.count_if(yes != y)
    return df.groupBy(*keys).agg(F.avg(F.when(yes == y, 1.0).otherwise(0.0)).alias("accuracy"), F.try_divide(2.0 * hit, 2 * hit + miss).alias("f1"))


def scores_of(df: DataFrame, label: str, score: str = "score", keys: list[str] = ()) -> DataFrame:
    keys = list(keys)
    auc, ap, rest = roc_auc(df, label, score, keys), average_precision(df, label, score, keys), accuracy_f1(df, label, score, keys=keys)
    if keys:
        return rest.join(auc, keys, "left").join(ap, keys, "left")
    return auc.crossJoin(ap).crossJoin(rest)  # one row each


def _runs_scored(df: DataFrame, label: str, id_col: str, features: str, seeds: int, share: float, dims: int) -> DataFrame:
    """run, label, score of the test rows of stratified_split by each seed from 1, from logistic_scores' model of its other rows; runs without
    any are left out. All runs are split, standardised and fitted in the same jobs."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    spark = df.sparkSession
    sizes = df.groupBy(label).agg(F.ceil(F.count("*") * F.lit(share)).alias("__n"))
    each = df.select(id_col, label, features, F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("run"))
    h = F.md5(F.concat_ws(":", F.lit("0"), F.concat(F.lit("split-"), F.col("run").cast("string")), F.col(id_col).cast("string")))  # draw's
    ranked = each.withColumn("__h", h).withColumn("__r", F.row_number().over(Window.partitionBy("run", label).orderBy("__h", id_col)))
    split = pinned(ranked.join(F.broadcast(sizes), label).select("run", F.col(label).alias("label"), F.col(features).alias("features"), (F.col("__r") <= F.col("__n")).alias("test")), "split")
    train = split.where("not test")
    counted = train.groupBy("run", "label").agg(F.count("*").alias("n")).collect()
    total = {run: [c.n for c in counted if c.run == run] for run in sorted({c.run for c in counted})}
    weights = [(c.run, c.label, sum(total[c.run]) / (len(total[c.run]) * c.n)) for c in counted]
    moments = []
    for r in train.groupBy("run").agg(Summarizer.metrics("mean", "variance").summary(array_to_vector("features")).alias("s")).select("run", "s.*").collect():
        n = sum(total[r.run])
        var = r.variance.toArray() * ((n - 1) / n if n > 1 else 0)
        moments.append((r.run, r["mean"].toArray().tolist(), [float(v) ** 0.5 if v > 0 else 1.0 for v in var]))
    z = F.zip_with(F.zip_with("features", "mean", lambda x, a: x - a), "std", lambda x, s: x / s)
    scaled = train.join(F.broadcast(spark.createDataFrame(moments, "run int, mean array<double>, std array<double>")), "run").select("run", "label", z.alias("features"))
    of_class = F.broadcast(spark.createDataFrame(weights, split.select("run", "label").schema.add("w", "double")))
    rows = pinned(scaled.join(of_class, ["run", "label"]).select("run", F.col("label").cast("double").alias("label"), "features", "w").coalesce(max(1, sum(map(sum, total.values())) // 50_000)), "rows")
    beta = weights_of_runs(rows, 1.0, dims, list(total))
    fitted = spark.createDataFrame([(run, mean, std, beta[run][:-1].tolist(), float(beta[run][-1])) for run, mean, std in moments], "run int, mean array<double>, std array<double>, beta array<double>, free double")
    score = F.aggregate(F.zip_with(z, "beta", lambda x, b: x * b), F.col("free"), lambda s, v: s + v)
    return split.where("test").join(F.broadcast(fitted), "run").select("run", "label", (1 / (1 + F.exp(-score))).alias("score"))


def repeated_auc(df: DataFrame, label: str, id_col: str, features: str, seeds: int = 10, share: float = 0.2) -> DataFrame:
    """auc_mean, auc_std, ap_mean, f1_mean, n over splits by several seeds; what cannot be computed is skipped. Runs of up to NEWTON
    features are made together."""
    held = pinned(df.select(id_col, label, features), "rows")
    dims = held.agg(F.max(F.size(features))).first()[0] or 0
    if dims <= NEWTON:
        runs = scores_of(pinned(_runs_scored(held, label, id_col, features, seeds, share, dims), "scored"), "label", keys=["run"])
    else:
        each = []
        for seed in range(1, seeds + 1):
            split = pinned(stratified_split(held, label, id_col, share, seed), "split")
            each.append(scores_of(pinned(logistic_scores(split.where("not test"), split.where("test"), label, features).select(label, "score"), "scored"), label))
        runs = reduce(DataFrame.unionByName, each)
    return runs.agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("ap").alias("ap_mean"), F.avg("f1").alias("f1_mean"), F.count("auc").alias("n"))


def leave_one_group_out(df: DataFrame, group: str, label: str, features: str) -> DataFrame:
    """group, n_train, n_test, auc, ap, accuracy, f1: each group scored by a model of the others."""
    out = []
    for (g,) in sorted(df.select(group).distinct().collect()):
        train, test = df.where(F.col(group) != g), df.where(F.col(group) == g)
        sizes = df.agg(F.count_if(F.col(group) != g).alias("n_train"), F.count_if(F.col(group) == g).alias("n_test"))
        out.append(sizes.crossJoin(scores_of(pinned(logistic_scores(train, test, label, features).select(label, "score"), "scored"), label)).withColumn(group, F.lit(g)))
    return reduce(DataFrame.unionByName, out)
