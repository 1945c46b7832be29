"""Counts to expression: library sizes, normalisation, variable genes, scaling, principal components, copy-number scores.

Counts are long: cell, gene, value; what is absent is zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ln1p
from ..session import pinned
from .order import percentiles

#: Cells whose ids are broadcast; cells of a gap that are listed at once; tasks at least that make the rows of genes.
MAX_CELLS, GAP, GENE_PARTS = 4_000_000, 1 << 16, 64


def cell_summary(counts: DataFrame, mito_prefix: str = "MT-") -> DataFrame:
    """cell, library, n_genes, pct_mito; pct_mito is null where the table has no such gene at all."""
    mito = F.upper(F.col("gene").cast("string")).startswith(mito_prefix)
    has = counts.agg(F.max(mito.cast("int")).alias("has"))
    out = counts.groupBy("cell").agg(F.sum("value").alias("library"), F.count_if(F.col("value") > 0).alias("n_genes"), F.sum(F.when(mito, F.col("value")).otherwise(0)).alias("m"))
    return out.crossJoin(F.broadcast(has)).select("cell", "library", "n_genes", F.when(F.col("has") == 1, F.try_divide(F.col("m") * 100.0, F.col("library"))).alias("pct_mito"))


def good_cells(counts: DataFrame, min_genes: int = 200, min_library: float = 500) -> DataFrame:
    """counts of the cells with enough genes and counts."""
    fit = counts.groupBy("cell").agg(F.count_if(F.col("value") > 0).alias("g"), F.sum("value").alias("l")).where((F.col("g") >= min_genes) & (F.col("l") >= min_library))
    return counts.join(fit.select("cell"), "cell", "left_semi")


def detected_genes(counts: DataFrame, min_cells: int = 5) -> DataFrame:
    """gene, n_cells of the genes found in at least min_cells cells."""
    return counts.where("value > 0").groupBy("gene").agg(F.count_distinct("cell").alias("n_cells")).where(F.col("n_cells") >= min_cells)


def log_normalised(counts: DataFrame, target: float | None = 1e6, min_cells: int = 0) -> DataFrame:
    """cell, gene, value = ln(1 + count * target / library): by the full library, before genes are dropped; target None is the
    median library. A cell without counts is an error."""
    sizes = counts.groupBy("cell").agg(F.sum("value").alias("library"))
    if target is None:
        sizes = pinned(sizes, "libraries")
        sizes = sizes.crossJoin(F.broadcast(percentiles(sizes, "library", [0.5]).select(F.get("q", F.lit(0)).alias("target"))))
    else:
        sizes = sizes.withColumn("target", F.lit(float(target)))
    kept = counts.join(detected_genes(counts, min_cells).select("gene"), "gene", "left_semi") if min_cells else counts
    joined = kept.join(sizes, "cell")
    safe = F.when(F.col("library") > 0, F.col("library")).otherwise(F.raise_error(F.lit("a cell has no counts")).cast("double"))
    return joined.select("cell", "gene", ln1p(F.col("value") * F.col("target") / safe).alias("value"))


def log_normalised_lenient(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """As log_normalised, with a library of 1 for cells without counts."""
    sizes = counts.groupBy("cell").agg(F.greatest(F.sum("value"), F.lit(1)).alias("library"))
    return counts.join(sizes, "cell").select("cell", "gene", ln1p(F.col("value") * F.lit(float(target)) / F.col("library")).alias("value"))


def gene_moments(values: DataFrame, n_cells: int | None = None) -> DataFrame:
    """gene, mean, var: population moments over all cells, absent ones as zero. n_cells: all cells, if some have no row in values."""
    sums = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = values.agg(F.count_distinct("cell").alias("n")) if n_cells is None else values.sparkSession.createDataFrame([(n_cells,)], "n long")
    mean = F.col("s") / F.col("n")
    return sums.crossJoin(F.broadcast(total)).select("gene", mean.alias("mean"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("var"))


def variable_genes(values: DataFrame, n: int = 2000, n_cells: int | None = None) -> DataFrame:
    """The n genes of the largest variance, to 9 places, ties to the lesser gene. n_cells: all cells, if some have none of the genes."""
    return gene_moments(values, n_cells).orderBy(F.desc(F.round("var", 9)), "gene").limit(n)


def dispersed_genes(values: DataFrame, n: int | None = 2000, flavour: str = "seurat", bins: int = 20, n_cells: int | None = None) -> DataFrame:
    """gene, dispersion: the n genes of the largest dispersion (None: all, in no order), normalised within bins of the mean.

    seurat: equal-width bins of ln(1 + mean), by mean and standard deviation of the log dispersion (a bin of one gene: 0
    and its dispersion); cell_ranger: bins by the mean's percentiles, by median and median absolute deviation.
    """
    from .labels import quantile_bin

    m = gene_moments(values, n_cells).where("mean > 0").select("gene", ln1p(F.col("mean")).alias("m"), F.col("mean").alias("raw"), (F.col("var") / F.col("mean")).alias("d"))
    if flavour == "seurat":
        span = m.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
        width = F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(bins)))
        b = m.crossJoin(F.broadcast(span)).select("gene", F.log(F.when(F.col("d") > 0, F.col("d"))).alias("d"), F.least(F.coalesce(F.floor(F.try_divide(F.col("m") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).alias("bin"))
        stats = b.groupBy("bin").agg(F.avg("d").alias("c"), F.stddev_samp("d").alias("s"))
        score = F.when(F.col("s").isNull(), F.lit(1.0)).otherwise(F.try_divide(F.col("d") - F.col("c"), F.col("s")))
    else:
        b = quantile_bin(m.select("gene", "raw", "d"), "raw", bins, "bin")
        centre = percentiles(b, "d", [0.5], ["bin"]).select("bin", F.get("q", F.lit(0)).alias("c"))
        far = b.join(F.broadcast(centre), "bin").select("bin", F.abs(F.col("d") - F.col("c")).alias("d"))  # a row a bin
        stats = centre.join(percentiles(far, "d", [0.5], ["bin"]).select("bin", F.get("q", F.lit(0)).alias("s")), "bin")
        score = F.try_divide(F.col("d") - F.col("c"), F.col("s"))
    out = b.join(stats, "bin").select("gene", F.coalesce(score, F.lit(0.0)).alias("dispersion"))
    return out if n is None else out.orderBy(F.desc("dispersion"), "gene").limit(n)


def scaled(values: DataFrame, bound: float = 10.0, ddof: int = 0, cells: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """cell, gene, value for every cell and gene: centred on the gene's mean over all cells and divided by its standard deviation
    (0 if that is 0), clipped. What is absent is zero, and has a value here. cells: all cells, if some have no row in values.
    places: to round to, before a gene's value of what is absent is given to its cells.

    What is present is shuffled, by gene. Cells are numbered, and the gaps between a gene's numbers become its other rows where they
    are, so that none of these is shuffled or kept; up to MAX_CELLS cells they get their ids by a broadcast table.
    """
    from .eigen import Numbered

    values = pinned(values.where(F.col("cell").isNotNull() & F.col("gene").isNotNull()).select("cell", "gene", "value"), "values")
    numbers = Numbered((values if cells is None else cells.where(F.col("cell").isNotNull())).select("cell").distinct(), "cell")
    ids = numbers.table.select(F.col("id").alias("cell"), "at")
    ids = F.broadcast(ids) if numbers.n <= MAX_CELLS else ids
    n = F.lit(numbers.n)
    by_gene = values.repartition(max(GENE_PARTS, 4 * values.sparkSession.sparkContext.defaultParallelism), "gene")
    means = by_gene.groupBy("gene").agg(F.sum("value").alias("s"), F.count("*").alias("present")).withColumn("mean", F.col("s") / n)
    apart = by_gene.join(means.select("gene", "mean"), "gene").groupBy("gene").agg(F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).alias("squares"))
    spread = F.sqrt(F.try_divide(F.col("squares") + (n - F.col("present")) * F.col("mean") * F.col("mean"), n - ddof))
    # less than this is what rounding makes of equal values
    stats = pinned(means.join(apart, "gene").select("gene", "mean", F.when(spread > 1e-12 * F.abs("mean"), spread).alias("sd")), "stats")

    def placed(value: Column) -> Column:
        out = clip(F.coalesce((F.coalesce(value, F.lit(0.0)) - F.col("mean")) / F.col("sd"), F.lit(0.0)), bound)
        return (out if places is None else F.round(out, places) + 0.0).alias("value")  # no negative zero

    there = by_gene.join(ids, "cell", "left").join(stats, "gene")
    present = there.where("at is not null").select("cell", "gene", placed(F.col("value")))
    between = F.arrays_zip(F.concat(F.array(F.lit(-1).cast("long")), "hits").alias("lo"), F.concat("hits", F.array(n.cast("long"))).alias("hi"))
    gaps = there.groupBy("gene", "mean", "sd").agg(F.sort_array(F.collect_list("at")).alias("hits")).select("gene", placed(F.lit(0.0)), F.explode(between).alias("gap"))
    gaps = gaps.select("gene", "value", (F.col("gap.lo") + 1).alias("lo"), (F.col("gap.hi") - 1).alias("hi")).where("lo <= hi")
    parts = gaps.select("gene", "value", "hi", F.explode(F.sequence("lo", "hi", F.lit(GAP).cast("long"))).alias("lo"))
    absent = parts.select("gene", "value", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + (GAP - 1)))).alias("at")).join(ids, "at")
    return present.unionByName(absent.select("cell", "gene", "value"))


def vectors(values: DataFrame, genes: list) -> DataFrame:
    """cell, features: an array in the order of genes, absent ones as 0. genes: a bounded list, such as the variable genes."""
    order = values.sparkSession.createDataFrame(list(enumerate(genes)), ["i", "gene"])
    pairs = values.join(F.broadcast(order), "gene").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    return pairs.select("cell", F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit(0.0))).alias("features"))


def principal_components(cells: DataFrame, k: int = 50, features: str = "features") -> DataFrame:
    """cell, pcs: scores on the first components of the centred features, signs fixed so that each component's largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = cells.select("cell", array_to_vector(features).alias("x"))
    mean = rows.select(Summarizer.mean(F.col("x"))).first()[0].toArray()
    k = min(k, len(mean))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    shift, signs = mean @ loadings, [float(s or 1) for s in signs]
    scored = model.transform(rows).select("cell", vector_to_array("y").alias("y"))
    return scored.select("cell", F.array(*((F.get("y", F.lit(i)) - float(shift[i])) * signs[i] for i in range(k))).alias("pcs"))


def sparse_components(values: DataFrame, k: int = 50) -> DataFrame:
    """cell, pcs: scores on the first components of the values (cell, gene, value), what is absent being 0, without a dense vector.

    Block Lanczos on the cells' products with each other, which are never made: those of the values' blocks with a block of columns,
    first by gene, then by cell; both where a block of genes lies, as long as a block of columns can be broadcast. The constant column is known as the root, and what lies along it is left out, which centres the
    genes. Signs are those of principal_components. A pair that repeats is added up, null values are left out, fewer genes than k give as
    many components, and an empty table no rows.
    """
    from .eigen import FEW, SHARED, WIDE_BLOCK, WIDEST, Gram, Numbered, Sparse, held, leading_packed

    rows = values.where(F.col("value").isNotNull() & F.col("gene").isNotNull() & F.col("cell").isNotNull())
    pairs = pinned(rows.select("cell", "gene", F.col("value").cast("double").alias("value")), "values")  # products add up what repeats
    cells, genes = Numbered(pairs.select("cell").distinct(), "cell"), Numbered(pairs.select("gene").distinct(), "gene")
    if not cells.n:
        return values.select("cell", F.array().cast("array<double>").alias("pcs")).limit(0)
    k = min(k, genes.n)
    most = min(k, cells.n - 1)  # components beyond have nothing left
    none = [F.lit(0.0)] * (k - most)
    if not most:
        return cells.table.select(F.col("id").alias("cell"), F.array(*none).alias("pcs"))
    at_cell = cells.table.select(F.col("id").alias("cell"), F.col("at").alias("i"))
    at_gene = genes.table.select(F.col("id").alias("gene"), F.col("at").alias("j"))
    both = pinned(pairs.join(at_cell, "cell").join(at_gene, "gene").select("i", "j", "value"), "entries")
    if cells.n * 8 * max(WIDE_BLOCK, k + 2) <= SHARED:
        gram = Gram(both, cells.n, genes.n)
        product, loadings = gram.times, gram.across
    else:
        by_cell, by_gene = Sparse(both, cells.n, genes.n), Sparse(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"), genes.n, cells.n)
        loadings = by_gene.times

        def product(x: DataFrame, width: int) -> DataFrame:
            return by_cell.times(by_gene.times(x, width), width, "y")

    root = cells.packed(cells.table.select("id", F.array(F.lit(1.0)).alias("q")), 1, "q")
    squares, axes = leading_packed(product, cells, root, most, most=WIDEST if cells.n <= FEW else None)
    axes = pinned(axes, "axes")
    sizes = np.sqrt(np.maximum(squares, 0.0))
    shares = np.divide(1.0, sizes, out=np.zeros(most), where=sizes > 0)

    def largest(batches):
        for batch in batches:
            for blk, y in zip(*batch.columns):
                a = held(y, most) * shares  # loadings
                first = np.round(np.abs(a), 9).argmax(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(most)), pa.array([blk.as_py()] * most, pa.int64()), pa.array(a[first, np.arange(most)])], names=["j", "blk", "a"])

    found = loadings(axes, most, "axes").mapInArrow(largest, "j long, blk long, a double")
    firsts = found.groupBy("j").agg(F.max_by("a", F.struct(F.round(F.abs("a"), 9), -F.col("blk"))).alias("a")).collect()  # k rows, of equals the first gene's
    signs = np.ones(most)
    for r in firsts:
        signs[r.j] = -1.0 if r.a < 0 else 1.0
    scale = [float(s) for s in sizes * signs]
    scored = cells.rows(axes, most, "axes")
    return scored.select(F.col("id").alias("cell"), F.array(*(F.get("axes", F.lit(j)) * scale[j] for j in range(most)), *none).alias("pcs"))


def depth_embedding(counts: DataFrame) -> DataFrame:
    """cell, embedding: the log of the library alone."""
    return counts.groupBy("cell").agg(F.array(ln1p(F.sum("value"))).alias("embedding"))


def standardised_axes(cells: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """Each axis of an embedding by its own mean and standard deviation."""
    long = cells.select(id_col, F.posexplode(embedding).alias("axis", "x"))
    stats = long.groupBy("axis").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.join(F.broadcast(stats), "axis").select(id_col, "axis", F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))
    return z.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "z"))), lambda e: e["z"]).alias(embedding))


def pseudo_batches(cells: DataFrame, features: str = "features", k: int = 8, seed: int = 0) -> DataFrame:
    """cells with batch: k-means clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cells.withColumn("x", array_to_vector(F.col(features).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="x", predictionCol="batch").fit(rows).transform(rows).drop("x")


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, window: int = 100) -> DataFrame:
    """df with smooth: the centred average over window rows in order, the first and last value standing in beyond the ends.

    With w rows at most as many as a group has, output i averages rows i - floor((w - 1) / 2) to i + floor(w / 2). For odd
    w the last row of a group has no output, as in the analysis that this serves.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    rows = df.withColumns({"i": F.row_number().over(by), "n": F.count("*").over(whole), "first": F.first(value).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "last": F.last(value).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "cum": F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("w", F.least(F.lit(window), F.col("n")).cast("int"))
    # cum at another row of the group, by joining on its number
    at = rows.select(*keys, F.col("i").alias("at"), F.col("cum").alias("cum_at"))
    low, high = F.floor((F.col("w") - 1) / 2).cast("int"), F.floor(F.col("w") / 2).cast("int")
    shifted = F.when(F.col("w") % 2 == 1, 1).otherwise(0)  # the odd case is one row late
    rows = rows.withColumns({"from": F.col("i") + shifted - low, "to": F.col("i") + shifted + high})
    rows = rows.withColumns({"lo": F.greatest(F.col("from"), F.lit(1)), "hi": F.least(F.col("to"), F.col("n").cast("int"))})
    one = rows.join(at.withColumnRenamed("at", "hi").withColumnRenamed("cum_at", "c_hi"), [*keys, "hi"]).withColumn("before", F.col("lo") - 1)
    two = one.join(at.withColumnRenamed("at", "before").withColumnRenamed("cum_at", "c_lo"), [*keys, "before"], "left")
    total = F.col("c_hi") - F.coalesce("c_lo", F.lit(0.0)) + F.greatest(1 - F.col("from"), F.lit(0)) * F.col("first") + F.greatest(F.col("to") - F.col("n"), F.lit(0)) * F.col("last")
    return two.where(~((F.col("w") % 2 == 1) & (F.col("i") == F.col("n")))).select(*df.columns, (total / F.col("w")).alias("smooth"))


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """df with smooth: the mean of value over up to window rows around each, fewer at the ends."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(-((window - 1) // 2), window // 2)
    return df.withColumn("smooth", F.avg(value).over(by))


def smoothing_weights(genes: DataFrame, window: int = 100) -> DataFrame:
    """gene, arm, weight: what each gene's value counts for in the average, over an arm, of its moving average (moving_average).

    Both are linear, so an arm's average can be taken of the values themselves. genes: gene, arm, start.
    """
    by = Window.partitionBy("arm").orderBy("start", "gene")
    placed = genes.select("gene", "arm", "start", F.row_number().over(by).alias("i"), F.count("*").over(Window.partitionBy("arm")).alias("n"))
    placed = placed.withColumn("w", F.least(F.lit(window), F.col("n")).cast("int")).withColumn("late", F.col("w") % 2)  # the odd case is one row late, and has one output less
    outputs = placed.where(F.col("i") <= F.col("n") - F.col("late"))
    read = outputs.select("arm", "n", "w", "late", F.explode(F.sequence(F.col("i") + F.col("late") - F.floor((F.col("w") - 1) / 2).cast("int"), F.col("i") + F.col("late") + F.floor(F.col("w") / 2).cast("int"))).alias("at"))
    counts = read.groupBy("arm", F.least(F.greatest("at", F.lit(1)), F.col("n")).cast("int").alias("i"), "n", "w", "late").agg(F.count("*").alias("c"))
    weights = counts.select("arm", "i", (F.col("c") / (F.col("w") * (F.col("n") - F.col("late")))).alias("weight"))
    return placed.select("gene", "arm", "i").join(weights, ["arm", "i"]).select("gene", "arm", "weight")


def arm_scores(values: DataFrame, genes: DataFrame, reference: DataFrame, window: int = 100, bound: float = 3.0) -> DataFrame:
    """cell, arm, score: copy-number scores. values: cell, gene, value; genes: gene, arm, start; reference: cells.

    Each gene is centred on the mean of all reference cells and clipped; a cell's genes are smoothed along each arm and
    averaged. What is absent is zero and counts as such: a cell's score is that of a cell without counts plus what its present
    genes change in it, so the dense matrix is never made. Genes that values has not are left out.
    """
    here = genes.dropDuplicates(["gene"]).join(values.select("gene").distinct(), "gene", "left_semi")
    asked = reference.select("cell").distinct()
    total = asked.agg(F.count("*").alias("n_reference"))
    base = values.join(asked, "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("s"))
    known = smoothing_weights(here, window).join(base, "gene", "left").crossJoin(F.broadcast(total)).select("gene", "arm", "weight", F.coalesce(F.col("s") / F.col("n_reference"), F.lit(0.0)).alias("base"))
    empty = clip(-F.col("base"), bound)
    arms = known.groupBy("arm").agg(F.sum(F.col("weight") * empty).alias("of_none"))
    change = F.col("weight") * (clip(F.col("value") - F.col("base"), bound) - empty)
    present = values.join(known, "gene").groupBy("cell", "arm").agg(F.sum(change).alias("change"))
    every = values.select("cell").distinct().crossJoin(F.broadcast(arms))  # some 40 arms
    return every.join(present, ["cell", "arm"], "left").select("cell", "arm", (F.col("of_none") + F.coalesce("change", F.lit(0.0))).alias("score"))
