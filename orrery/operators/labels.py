"""Label rules and alignments: bins, marker panels, dual labels, clonality, gated pools, label joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import percentiles

# Bins and thresholds


def quantile_bin(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """df with name: the number of inner quantile edges (linear interpolation) that are at most the value, 0 to bins - 1."""
    edges = percentiles(df, value, [i / bins for i in range(1, bins)]).select(F.col("q").alias("__edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("__edges", lambda e: e <= F.col(value)))).drop("__edges")


def tertile_label(df: DataFrame, value: str, low: float = 0.33, high: float = 0.67, names: tuple[str, str, str] = ("low", "mid", "high")) -> DataFrame:
    """df with label: high from the upper quantile on, low up to the lower, else mid."""
    q = percentiles(df, value, [low, high]).select(F.get("q", F.lit(0)).alias("__lo"), F.get("q", F.lit(1)).alias("__hi"))
    out = df.crossJoin(F.broadcast(q)).withColumn("label", F.when(F.col(value) >= F.col("__hi"), names[2]).when(F.col(value) <= F.col("__lo"), names[0]).otherwise(names[1]))
    return out.drop("__lo", "__hi")


def z_score(df: DataFrame, value: str, name: str = "z", ddof: int = 0, keys: list[str] = ()) -> DataFrame:
    """df with the value's z over all rows, or those with equal keys; 0 without spread. Statistics are joined, not windowed."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), (F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)).alias("__s"))
    joined = df.join(F.broadcast(stats), list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(name, F.coalesce(F.try_divide(F.col(value) - F.col("__m"), F.col("__s")), F.lit(0.0))).drop("__m", "__s")


def cycling_label(df: DataFrame, value: str) -> DataFrame:
    """df with label: proliferating above a z of 1, resting below 0, null between."""
    return z_score(df, value).withColumn("label", F.when(F.col("z") > 1, "proliferating").when(F.col("z") < 0, "resting"))


# Marker panels


def panel_means(values: DataFrame, panels: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, panel, ord, score: mean of a panel's genes that the table has, absent values as 0. panels: panel, ord, gene."""
    present = panels.join(values.select("gene").distinct(), "gene", "left_semi")
    sizes = present.groupBy("panel", "ord").agg(F.count("*").alias("size"))
    sums = values.join(F.broadcast(present), "gene").groupBy("cell", "panel").agg(F.sum("value").alias("s"))
    grid = cells.select("cell").distinct().crossJoin(F.broadcast(sizes))
    return grid.join(sums, ["cell", "panel"], "left").select("cell", "panel", "ord", (F.coalesce("s", F.lit(0.0)) / F.col("size")).alias("score"))


def best_panel(scores: DataFrame, min_top: float | None = 0.5, margin: float = 0.25, unknown: str = "Unknown", strict: bool = False) -> DataFrame:
    """cell, label, top, second: the panel with the highest score (ties to the lesser ord) if it is min_top at least (above it, if strict) and leads by margin."""
    by = Window.partitionBy("cell").orderBy(F.desc("score"), "ord")
    top = scores.withColumn("r", F.row_number().over(by)).where("r <= 2").groupBy("cell").agg(F.max(F.when(F.col("r") == 1, F.col("panel"))).alias("panel"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    high = F.lit(True) if min_top is None else F.col("top") > min_top if strict else F.col("top") >= min_top
    clear = F.col("second").isNull() | (F.col("top") - F.col("second") >= margin)
    return top.select("cell", F.when(high & clear, F.col("panel")).otherwise(unknown).alias("label"), "top", "second")


def panel_label(values: DataFrame, panels: DataFrame, cells: DataFrame, min_top: float = 0.5, margin: float = 0.25, ddof: int = 1) -> DataFrame:
    """cell, label, top, second by each panel's z over the cells."""
    z = z_score(panel_means(values, panels, cells), "score", "z", ddof, ["panel"]).select("cell", "panel", "ord", F.col("z").alias("score"))
    return best_panel(z, min_top, margin)


def signature_scores(values: DataFrame, panels: DataFrame, cells: DataFrame, controls: DataFrame) -> DataFrame:
    """cell, panel, ord, score: a panel's mean less that of its control genes. controls: panel, gene."""
    own = panel_means(values, panels, cells)
    base = panel_means(values, controls.join(F.broadcast(panels.select("panel", "ord").distinct()), "panel"), cells).select("cell", "panel", F.col("score").alias("base"))
    return own.join(base, ["cell", "panel"], "left").select("cell", "panel", "ord", (F.col("score") - F.coalesce("base", F.lit(0.0))).alias("score"))


def signature_label(scores: DataFrame, margin: float = 0.05) -> DataFrame:
    return best_panel(scores, 0.0, margin, strict=True)


def community_label(scores: DataFrame, communities: DataFrame, least: float = 0.1) -> DataFrame:
    """cell, community, label: each community takes the panel of its highest mean score, if above least."""
    joined = scores.join(communities, "cell").groupBy("community", "panel").agg(F.avg("score").alias("m"), F.min("ord").alias("ord"))
    best = joined.groupBy("community").agg(F.max_by("panel", F.struct("m", -F.col("ord"))).alias("panel"), F.max("m").alias("m"))
    return communities.join(F.broadcast(best), "community").select("cell", "community", F.when(F.col("m") > least, F.col("panel")).otherwise("Unknown").alias("label"))


def cluster_panel_scores(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, panel, score: mean over a cluster's cells of their panel means."""
    return scores.join(clusters, "cell").groupBy("cluster", "panel").agg(F.avg("score").alias("score"))


def cluster_override(cluster_scores: DataFrame, pinned: dict[str, str], immune: list[str], margin: float = 0.1) -> DataFrame:
    """cluster, label: immune where the best immune panel leads every other by margin, unless pinned to a label."""
    agg = cluster_scores.groupBy("cluster").agg(F.max(F.when(F.col("panel").isin(*immune), F.col("score"))).alias("i"), F.max(F.when(~F.col("panel").isin(*immune), F.col("score"))).alias("o"))
    pin = F.create_map(*(F.lit(x) for kv in pinned.items() for x in kv)) if pinned else F.create_map()
    rule = F.when(F.coalesce(F.col("i") - F.col("o") >= margin, F.col("i").isNotNull()), "immune").otherwise("other")
    return agg.select("cluster", F.coalesce(F.try_element_at(pin.cast("map<string,string>"), F.col("cluster").cast("string")), rule).alias("label"))


# Rules over labels


def dual_labels(labels: DataFrame, barcode: str, label: str, rule: str = "excluded") -> DataFrame:
    """barcode, label, dual: one row per barcode; of a barcode with both labels, by rule: excluded (it goes), dual_mal
    (malignant) or dual_immune (immune)."""
    seen = labels.where(F.col(barcode).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(barcode).alias("barcode")).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    dual = F.col("lo") != F.col("hi")
    picked = {"excluded": F.lit(None).cast("string"), "dual_mal": F.lit("malignant"), "dual_immune": F.lit("immune")}[rule]
    out = seen.select("barcode", F.when(dual, picked).otherwise(F.col("lo")).alias("label"), dual.alias("dual"))
    return out.where("label is not null") if rule == "excluded" else out


def clonality(cells: DataFrame, cell: str, clone: str, threshold: int = 10) -> DataFrame:
    """cell, size, clonality: expanded from threshold on, non_expanded alone or without a clonotype, else other. Sizes are joined, so that a large clone is no task of its own."""
    sizes = cells.where(F.col(clone).isNotNull()).groupBy(F.col(clone).alias("__c")).agg(F.count("*").alias("size"))
    joined = cells.join(sizes, F.col(clone) == F.col("__c"), "left")
    kind = F.when(F.col("size") >= threshold, "expanded").when(F.col("size").isNull() | (F.col("size") == 1), "non_expanded").otherwise("other")
    return joined.select(cell, F.coalesce("size", F.lit(0)).alias("size"), kind.alias("clonality"))


def gated(cells: DataFrame, scores: list[str], low: str, threshold: float, low_threshold: float) -> DataFrame:
    """Cells whose highest of the scores reaches threshold and whose low marker stays below its own."""
    return cells.where((F.greatest(*scores) >= threshold) & (F.col(low) < low_threshold))


def pools(cells: DataFrame, status: str, kind: str, malignant: list[str], immune: list[str]) -> DataFrame:
    """cells with pool: malignant status among allowed types, normal status among immune types; the rest go."""
    pool = F.when((F.col(status) == "malignant") & F.col(kind).isin(*malignant), "malignant").when((F.col(status) == "normal") & F.col(kind).isin(*immune), "immune")
    return cells.withColumn("pool", pool).where("pool is not null")


def without_specimens(cells: DataFrame, specimen: str, excluded: DataFrame) -> DataFrame:
    return cells.join(excluded.select(F.col(excluded.columns[0]).alias(specimen)).distinct(), specimen, "left_anti")


def with_fallback(df: DataFrame, primary: str, fallback: str, name: str = "label") -> DataFrame:
    return df.withColumn(name, F.coalesce(primary, fallback))


# Alignments


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each keys, the first in order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def align_labels(barcodes: DataFrame, labels: DataFrame, key: str = "barcode") -> DataFrame:
    """barcodes with the labels' columns, null where unlabelled. A label of a barcode that the matrix has not, or a barcode
    that either side repeats, is an error when the result is read."""
    missing = labels.join(barcodes, key, "left_anti").agg(F.count("*").alias("m"))
    twice = labels.groupBy(key).count().where("count > 1").agg(F.count("*").alias("t1")).crossJoin(barcodes.groupBy(key).count().where("count > 1").agg(F.count("*").alias("t2")))
    checks = missing.crossJoin(twice)
    joined = barcodes.join(labels, key, "left").crossJoin(F.broadcast(checks))
    good = (F.col("m") == 0) & (F.col("t1") == 0) & (F.col("t2") == 0)
    return joined.withColumn(key, F.when(good, F.col(key)).otherwise(F.raise_error(F.lit("labels and matrix barcodes do not match one to one")).cast("string"))).drop("m", "t1", "t2")


def permutation(names: DataFrame, targets: DataFrame, name: str, at: str) -> DataFrame:
    """name, source_at, target_at: where each name of one axis stands in the other. A name that either side lacks or repeats
    is an error when the result is read, as a row for a row cannot be had then."""
    a = names.groupBy(F.col(name).alias("name")).agg(F.first(at).alias("source_at"), F.count("*").alias("n1"))
    b = targets.groupBy(F.col(name).alias("name")).agg(F.first(at).alias("target_at"), F.count("*").alias("n2"))
    both = a.join(b, "name", "full_outer")
    good = F.col("name").isNotNull() & F.coalesce((F.col("n1") == 1) & (F.col("n2") == 1), F.lit(False))
    kind = dict(both.dtypes)["name"]
    return both.select(F.when(good, F.col("name")).otherwise(F.raise_error(F.lit("the axes do not have the same names once each")).cast(kind)).alias("name"), "source_at", "target_at")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None, strict: bool = False) -> DataFrame:
    """df with value from a table, default where the key has none; strict: that is an error when the result is read.
    So is a key that the table repeats."""
    once = table.groupBy(F.col(key).alias("lookup_key")).agg(F.first(value).alias("found"), F.count("*").alias("times"))
    kind = dict(table.dtypes)[value]
    wrong = lambda text: F.raise_error(F.lit(text)).cast(kind)
    missing = wrong("a key is not in the table") if strict else F.lit(default).cast(kind)
    joined = df.join(once, df[key] == once["lookup_key"], "left")
    shown = F.when(F.col("times") > 1, wrong("a key is in the table more than once")).when(F.col("times").isNull(), missing).otherwise(F.coalesce("found", F.lit(default).cast(kind)) if default is not None else F.col("found"))
    return joined.withColumn(value, shown).drop("lookup_key", "found", "times")


def crosswalk(specimens: DataFrame, donors: DataFrame) -> DataFrame:
    """specimen, donor, covered: every specimen of either side; covered where both have it."""
    s, d = specimens.select("specimen", F.lit(True).alias("has")), donors.select("specimen", "donor")
    return s.join(d, "specimen", "full_outer").select("specimen", "donor", (F.col("has").isNotNull() & F.col("donor").isNotNull()).alias("covered"))


def coverage(labels: DataFrame, raw: DataFrame) -> DataFrame:
    """sample, n_labels, n_raw, n_exact, n_absent: how many of a sample's label barcodes its matrix has, prefixes `sample_` taken off."""
    bare = F.when(F.col("barcode").startswith(F.concat(F.col("sample"), F.lit("_"))), F.expr("substr(barcode, length(sample) + 2)")).otherwise(F.col("barcode"))
    wanted = labels.select("sample", bare.alias("barcode")).distinct()
    have = raw.select("sample", "barcode", F.lit(1).alias("hit")).distinct()
    matched = wanted.join(have, ["sample", "barcode"], "left").groupBy("sample").agg(F.count("*").alias("n_labels"), F.count("hit").alias("n_exact"))
    sizes = have.groupBy("sample").agg(F.count("*").alias("n_raw"))
    return matched.join(sizes, "sample", "left").select("sample", "n_labels", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), "n_exact", (F.col("n_labels") - F.col("n_exact")).alias("n_absent"))


def matched_sources(samples: DataFrame, sources: DataFrame, pattern: str, aliases: dict[str, str] = {}) -> DataFrame:
    """sample, source, status: the one source whose name yields the sample's by pattern (group 1), or alias; ambiguous, missing
    and shared sources say so."""
    alias = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)).cast("map<string,string>") if aliases else F.create_map().cast("map<string,string>")
    parts = sources.select("source", F.regexp_extract("source", pattern, 1).alias("part"))
    wanted = samples.select("sample", F.coalesce(F.try_element_at(alias, F.col("sample")), F.col("sample")).alias("part"))
    found = wanted.join(parts, "part", "left").groupBy("sample").agg(F.count("source").alias("n"), F.min("source").alias("source"))
    shared = found.where("n = 1").groupBy("source").agg(F.count("*").alias("users"))
    return found.join(shared, "source", "left").select("sample", F.when(F.col("n") == 1, F.col("source")).alias("source"), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.col("users") > 1, "shared").otherwise("ok").alias("status"))


def block_members(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """cells (sample, cluster, ...) with is_tumour: whether (sample, cluster) is among the blocks."""
    return cells.join(blocks.select("sample", "cluster").distinct().withColumn("__b", F.lit(True)), ["sample", "cluster"], "left").withColumn("is_tumour", F.col("__b").isNotNull()).drop("__b")


def unmatched_blocks(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    return blocks.join(cells.select("sample", "cluster").distinct(), ["sample", "cluster"], "left_anti")


def containment(total: DataFrame, sub: DataFrame, key: str) -> DataFrame:
    """n_shared, n_outside: how many of sub's keys the total has, and has not."""
    s = sub.select(key).distinct().join(total.select(key).distinct().withColumn("__t", F.lit(1)), key, "left")
    return s.agg(F.count("__t").alias("n_shared"), (F.count("*") - F.count("__t")).alias("n_outside"))


def gene_arms(positions: DataFrame, centromeres: DataFrame) -> DataFrame:
    """gene, chrom, start, arm: p before the centromere, q from it on; of a gene placed twice the first place counts."""
    one = first_of(positions, ["gene"], ["chrom", "start"])
    return one.join(F.broadcast(centromeres), "chrom").select("gene", "chrom", "start", F.concat("chrom", F.when(F.col("start") < F.col("centromere"), "p").otherwise("q")).alias("arm"))


def both_maps(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """key, value_1, value_2 of every key of either table."""
    return one.select(key, F.col(value).alias(f"{value}_1")).join(two.select(key, F.col(value).alias(f"{value}_2")), key, "full_outer")


# Counts and grids


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """One row per value of rows, a count per given value of columns, 0 where there is none."""
    return df.groupBy(rows).pivot(columns, values).count().fillna(0)


def grid(df: DataFrame, rows: str, columns: str, values: list, cell: str) -> DataFrame:
    """A fixed grid of means: null where a combination is absent."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(cell))


def qualifying(df: DataFrame, patient: str, is_a: Column, is_b: Column, minimum: int) -> DataFrame:
    return df.where(F.col(patient).isNotNull()).groupBy(patient).agg(F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b")).withColumn("qualifies", (F.col("n_a") >= minimum) & (F.col("n_b") >= minimum))


def in_tile(points: DataFrame, x: str, y: str, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Points of a half-open tile."""
    return points.where((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1))


def in_centre(points: DataFrame, x: str, y: str, half: float) -> DataFrame:
    """Points closer than half to the middle of the points' extent on either axis."""
    box = points.agg(((F.min(x) + F.max(x)) / 2.0).alias("__cx"), ((F.min(y) + F.max(y)) / 2.0).alias("__cy"))
    return points.crossJoin(F.broadcast(box)).where((F.abs(F.col(x) - F.col("__cx")) < half) & (F.abs(F.col(y) - F.col("__cy")) < half)).drop("__cx", "__cy")


def shared_genes(files: DataFrame) -> DataFrame:
    """gene of those that every file has. files: file, gene."""
    n = files.agg(F.count_distinct("file").alias("n"))
    return files.groupBy("gene").agg(F.count_distinct("file").alias("c")).crossJoin(F.broadcast(n)).where("c = n").select("gene")
