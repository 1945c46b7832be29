"""Samplers that any engine repeats: rows are ordered by the hash of seed, stage and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import draw


def _ranked(df: DataFrame, keys: list[str], id_col: str, seed: int, stage: str, name: str = "r") -> DataFrame:
    return df.withColumn("h", draw(seed, stage, F.col(id_col))).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("h", id_col)))


def first_n(df: DataFrame, n: int, id_col: str, seed: int = 0, stage: str = "uniform") -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    return df.withColumn("h", draw(seed, stage, F.col(id_col))).orderBy("h", id_col).limit(n).drop("h")


def stratified_minima_first(df: DataFrame, patient: str, id_col: str, is_a: Column, is_b: Column, minimum: int = 10, cap: int = 60, total: int = 3500, seed: int = 0) -> DataFrame:
    """patient, id, arm of the cells chosen: of patients with minimum cells in both arms, up to cap each; if that is more
    than total, cells above each arm's minimum are dropped at random. An overlap of the arms, or a total below the minima, is an error.
    """
    both = F.raise_error(F.lit("arms overlap")).cast("string")
    arms = df.withColumn("arm", F.when(is_a & is_b, both).when(is_a, "a").when(is_b, "b")).where("arm is not null").select(F.col(patient).alias("patient"), F.col(id_col).alias("id"), "arm")
    sizes = arms.groupBy("patient").agg(F.count_if(F.col("arm") == "a").alias("na"), F.count_if(F.col("arm") == "b").alias("nb"))
    fit = sizes.where((F.col("na") >= minimum) & (F.col("nb") >= minimum))
    taken = _ranked(arms.join(fit.select("patient"), "patient"), ["patient", "arm"], "id", seed, "stratified-sample").where(F.col("r") <= cap)
    counts = taken.agg(F.count("*").alias("n"), F.count_if(F.col("r") <= minimum).alias("floor"))
    extra = taken.where(F.col("r") > minimum)
    room = counts.select(F.when(F.col("n") <= total, F.col("n")).when(F.col("floor") > total, F.raise_error(F.lit("the cap cannot honour the minima")).cast("bigint")).otherwise(total - F.col("floor")).alias("room"))
    # there is never room for more than total, so that no more are numbered
    ordered = extra.withColumn("h2", draw(seed, "surplus", F.col("id"))).orderBy("h2", "id").limit(total).withColumn("pos", F.row_number().over(Window.orderBy("h2", "id")))
    kept = ordered.crossJoin(F.broadcast(room)).where("pos <= room")
    return taken.where(F.col("r") <= minimum).select("patient", "id", "arm").unionByName(kept.select("patient", "id", "arm"))


def sampling_audit(df: DataFrame, patient: str, is_a: Column, is_b: Column, minimum: int = 10) -> DataFrame:
    """patient, n_a, n_b, qualifies, reason."""
    out = df.groupBy(F.col(patient).alias("patient")).agg(F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"))
    fit = (F.col("n_a") >= minimum) & (F.col("n_b") >= minimum)
    return out.select("patient", "n_a", "n_b", fit.alias("qualifies"), F.when(~fit, "below_min_per_group").alias("reason"))


def capped_then_global(df: DataFrame, keys: list[str], id_col: str, cap: int, total: int, seed: int = 0) -> DataFrame:
    """Up to cap rows of each stratum, then total of all."""
    return first_n(_ranked(df, keys, id_col, seed, "stratum").where(F.col("r") <= cap).drop("h", "r"), total, id_col, seed, "global")


def even_with_top_up(df: DataFrame, patient: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows: as many of each patient as fit evenly, the rest from what is left over."""
    share = df.agg(F.floor(F.lit(n) / F.count_distinct(patient)).alias("share"))
    ranked = _ranked(df, [patient], id_col, seed, "even").crossJoin(F.broadcast(share)).drop("h")
    even = ranked.where("r <= share").drop("r", "share")
    rest = ranked.where("r > share").drop("r", "share").withColumn("h", draw(seed, "top-up", F.col(id_col))).orderBy("h", id_col).limit(n).withColumn("pos", F.row_number().over(Window.orderBy("h", id_col)))
    missing = even.agg((F.lit(n) - F.count("*")).alias("missing"))
    return even.unionByName(rest.crossJoin(F.broadcast(missing)).where("pos <= missing").drop("h", "pos", "missing"))


def balanced_arms(df: DataFrame, id_col: str, is_a: Column, n: int, seed: int = 0) -> DataFrame:
    """Both arms cut to min(n, smaller arm); df with arm."""
    arms = df.withColumn("arm", F.when(is_a, "a").otherwise("b"))
    room = arms.groupBy("arm").count().agg(F.least(F.lit(n), F.min("count")).alias("room"))
    return _ranked(arms, ["arm"], id_col, seed, "balanced").crossJoin(F.broadcast(room)).where("r <= room").drop("h", "r", "room")


def independent_arms(df: DataFrame, arm: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    return _ranked(df, [arm], id_col, seed, "arms").where(F.col("r") <= n).drop("h", "r")


def by_quota(df: DataFrame, label: str, id_col: str, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """As many rows of each label as its quota."""
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    return _ranked(df.where(F.col(label).isin(*quotas)), [label], id_col, seed, "quota").where(F.col("r") <= quota[F.col(label)]).drop("h", "r")


def sampled_edges(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n edges (u, v) without replacement; all if there are no more."""
    return edges.withColumn("h", draw(seed, "edges", F.col("u"), F.col("v"))).orderBy("h", "u", "v").limit(n).drop("h")


def random_panels(genes: DataFrame, gene: str, size: int, panels: int, seed: int = 0) -> DataFrame:
    """panel, gene: random panels of genes."""
    each = genes.select(gene).crossJoin(genes.sparkSession.range(panels).withColumnRenamed("id", "panel"))
    return each.withColumn("h", draw(seed, "panel", F.col("panel"), F.col(gene))).withColumn("r", F.row_number().over(Window.partitionBy("panel").orderBy("h", gene))).where(F.col("r") <= size).select("panel", gene)


def gaussian_null(ids: DataFrame, id_col: str, dims: int, seed: int = 0) -> DataFrame:
    """id, embedding: independent normal coordinates, by the hash of id and axis, so that rows keep theirs wherever they are."""

    def uniform(j, which):
        return (F.conv(F.substring(draw(seed, f"null-{which}", F.col(id_col), j), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))

    axes = F.sequence(F.lit(1), F.lit(dims))
    return ids.select(id_col, F.transform(axes, lambda j: F.sqrt(-2 * F.log(uniform(j, 1))) * F.cos(2 * F.pi() * uniform(j, 2))).alias("embedding"))


def control_genes(genes: DataFrame, gene: str, level: str, markers: DataFrame, bins: int = 25, per_bin: int = 50, seed: int = 0) -> DataFrame:
    """gene, bin: up to per_bin genes, markers left out, from each bin of the level that holds a marker."""
    from .labels import quantile_bin

    binned = quantile_bin(genes.select(gene, level), level, bins, "bin")
    wanted = binned.join(markers.select(gene), gene, "left_semi").select("bin").distinct()
    rest = binned.join(markers.select(gene), gene, "left_anti").join(wanted, "bin")
    return _ranked(rest, ["bin"], gene, seed, "controls").where(F.col("r") <= per_bin).select(gene, "bin")
