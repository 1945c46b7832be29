"""Whole analyses, from points to pooled effects. Each takes its inputs as tables and gives tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.scalars import draw
from ..operators import batches, curvature, diffusion, effects, gates, graph, labels, meta, ml, models, normalize, sampling, ward
from ..session import pinned


def node_curvature(points: DataFrame, id_col: str, vector: str, k: int = 15, n_edges: int = 6000, alpha: float = 0.5, seed: int = 0, kind: str = "ollivier") -> tuple[DataFrame, DataFrame]:
    """Nodes with the mean curvature of their measured edges, and the graph. kind: ollivier, over n_edges sampled edges, or forman, over all."""
    edges = pinned(graph.knn_graph(points, id_col, vector, k), "edges")
    return _nodes(points, id_col, edges, n_edges, alpha, seed, kind), edges


def node_curvature_or_none(points: DataFrame, id_col: str, vector: str, k: int = 15, n_edges: int = 6000, alpha: float = 0.5) -> tuple[DataFrame, int]:
    """node_curvature's nodes, and how many points share their place with another. Curvature is not estimable on these: every node is
    then given as non_estimable_coincident, without a curvature; no edge is dropped or point moved for an answer."""
    bad = graph.coincident_count(points, vector).first()[0]
    if bad:
        none = F.lit(None).cast("double")
        return points.select(F.col(id_col).alias("id"), none.alias("kappa"), F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("n_incident_measured"), none.alias("coverage_fraction"), F.lit("non_estimable_coincident").alias("status")), bad
    return node_curvature(points, id_col, vector, k, n_edges, alpha)[0], 0


def _one_delta(rows: DataFrame, is_a: Column, bad: int) -> DataFrame:
    """delta, null if there is none, and n_coincident: one row."""
    return effects.mann_whitney(rows, [], "kappa", is_a).agg(F.first("delta").alias("delta"), F.lit(bad).cast("long").alias("n_coincident"))


def _nodes(points: DataFrame, id_col: str, edges: DataFrame, n_edges: int, alpha: float = 0.5, seed: int = 0, kind: str = "ollivier") -> DataFrame:
    kappa = graph.forman(edges).withColumnRenamed("forman", "kappa") if kind == "forman" else curvature.ollivier_edges(edges, sampling.sampled_edges(edges, n_edges, seed), alpha)
    return pinned(graph.node_summary(points.select(F.col(id_col).alias("id")), edges, kappa.select("u", "v", "kappa")), "nodes")


def _measured(nodes: DataFrame, points: DataFrame, id_col: str, *columns: Column) -> DataFrame:
    return nodes.where("status = 'measured'").join(points.select(F.col(id_col).alias("id"), *columns), "id")


def patient_meta(points: DataFrame, id_col: str, vector: str, patient: str, is_a: Column, k: int = 15, n_edges: int = 6000, min_cells: int = 10, cap: int = 60, total: int = 3500, replicates: int = 1000, kind: str = "ollivier") -> DataFrame:
    """Cells sampled within patients, graph, curvature, contrasts within patients, pooled effect with its bootstrap, decision: one row."""
    chosen = sampling.stratified_minima_first(points, patient, id_col, is_a, ~is_a, min_cells, cap, total)
    cells = pinned(points.join(chosen.select(F.col("id").alias(id_col), "arm"), id_col), "chosen")
    nodes, _ = node_curvature(cells, id_col, vector, k, n_edges, kind=kind)
    rows = _measured(nodes, cells, id_col, F.col(patient).alias("patient"), (F.col("arm") == "a").alias("is_a"))
    table = pinned(effects.estimable(effects.per_patient_contrasts(rows, "patient", "kappa", F.col("is_a"), min_cells)), "contrasts")
    pooled = meta.protocol_decision(meta.with_tails(meta.dersimonian_laird(table)))
    boot = meta.interval(meta.bootstrap_pooled(table, "patient_id", replicates)).select(F.col("b").alias("replicates"), F.col("mean").alias("boot_mean"), F.col("ci_lo").alias("boot_lo"), F.col("ci_hi").alias("boot_hi"))
    return pooled.crossJoin(boot)  # one row each


def dual_label_variants(points: DataFrame, id_col: str, vector: str, patient: str, marks: DataFrame, **options) -> DataFrame:
    """variant and patient_meta's row, malignant against immune, for each rule on cells that both labels were given to.
    marks: barcode (as id), label."""
    out = None
    for rule in ("excluded", "dual_mal", "dual_immune"):
        decided = labels.dual_labels(marks, "barcode", "label", rule).select(F.col("barcode").alias(id_col), F.col("label").alias("decided"))
        one = patient_meta(points.select(id_col, vector, patient).join(decided, id_col), id_col, vector, patient, F.col("decided") == "malignant", **options).withColumn("variant", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out


def label_validation(points: DataFrame, id_col: str, vector: str, schemes: dict[str, Column], k: int = 15, n_edges: int = 4000, minimum: int = 30, total: int | None = 1200, kind: str = "ollivier") -> tuple[DataFrame, DataFrame]:
    """(scheme, n1, n2, delta, p, ok) over one graph whose curvature is measured once, whatever the labels; and the verdict. A scheme's
    column says whether a cell is of the first arm, null that it is of none. total: cells drawn, all if None."""
    cells = points if total is None else pinned(sampling.first_n(points, total, id_col), "cells")
    nodes, _ = node_curvature(cells, id_col, vector, k, n_edges, kind=kind)
    found = None
    for name, is_a in schemes.items():
        rows = graph.contrast_from(nodes, cells.select(F.col(id_col).alias("id"), is_a.alias("first")), F.col("first"), ~F.col("first"), minimum)
        u = effects.mann_whitney(rows, [], "kappa", F.col("arm") == "a")
        one = u.select(F.lit(name).alias("scheme"), "n1", "n2", "delta", tails.mann_whitney_two_sided(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties")).alias("p"), F.lit(True).alias("ok"))
        found = one if found is None else found.unionByName(one)
    found = pinned(found, "schemes")
    return found, meta.label_verdict(found, list(schemes))


def embeddings_against(points: DataFrame, id_col: str, vector: str, batch: str, depth: str, is_a: Column, k: int = 15, n_edges: int = 4000, seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(method, delta) of the contrast on the original embedding, one corrected for batches, random ones and sequencing depth
    alone; and the verdict."""
    ids = points.select(F.col(id_col).alias("id"), is_a.alias("is_a"), F.col(batch).alias("batch"))
    corrected = batches.batch_corrected(points, id_col, batch, vector).select("id", F.col("features").alias("x"))
    sets = [("original", points.select(F.col(id_col).alias("id"), F.col(vector).alias("x"))), ("corrected", corrected)]
    sets += [("random", sampling.gaussian_null(points.select(F.col(id_col).alias("id")), "id", 50, seed).select("id", F.col("embedding").alias("x"))) for seed in range(seeds)]
    sets.append(("depth", points.select(F.col(id_col).alias("id"), F.array(F.log1p(F.col(depth).cast("double"))).alias("x"))))
    out = None
    for name, rows in sets:
        edges = pinned(graph.knn_graph(pinned(rows, "embedding"), "id", "x", k, coincident="skip"), "edges")
        nodes = _nodes(ids, "id", edges, n_edges)
        one = effects.mann_whitney(_measured(nodes, ids, "id", F.col("is_a")), [], "kappa", F.col("is_a")).select(F.lit(name).alias("method"), "delta")
        out = one if out is None else out.unionByName(one)
    out = pinned(out, "deltas")
    return out, meta.batch_verdict(out)


def parameter_grid(counts: DataFrame, is_a: DataFrame, n_genes: list[int] = (500, 1000, 2000), n_components: list[int] = (10, 30, 50), ks: list[int] = (10, 15), alphas: list[float] = (0.0, 0.25, 0.5, 0.75), n_edges: int = 3000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, components, k, alpha, delta, n_coincident) of the contrast at every point of a grid, 72 by default; the verdict; the
    variance by axis. is_a: cell, is_a. A graph is made once for its k, whatever alpha. Where cells coincide, delta is null, which
    is no run for the verdict, and n_coincident says how many do."""
    arms = pinned(is_a.select(F.col("cell").alias("id"), "is_a"), "arms")
    out = None
    for genes in n_genes:
        for components in n_components:
            cells = pinned(from_counts(counts, genes, components), "components")
            bad = graph.coincident_count(cells, "pcs").first()[0]
            for k in ks:
                edges = None if bad else pinned(graph.knn_graph(cells, "cell", "pcs", k), "edges")
                for alpha in alphas:
                    nodes = node_curvature_or_none(cells, "cell", "pcs")[0] if bad else _nodes(arms, "id", edges, n_edges, alpha)
                    one = _one_delta(_measured(nodes, arms, "id", F.col("is_a")), F.col("is_a"), bad).select(*(F.lit(x).alias(n) for n, x in (("genes", genes), ("components", components), ("k", k), ("alpha", alpha))), "delta", "n_coincident")
                    out = one if out is None else out.unionByName(one)
    out = pinned(out, "grid")
    return out, meta.stability(out), meta.variance_by_axis(out, ["genes", "components", "k", "alpha"], "delta")


def curvature_of_panels(values: DataFrame, is_a: DataFrame, size: int = 2000, panels: int = 20, n_components: int = 50, k: int = 15, n_edges: int = 3000) -> DataFrame:
    """The contrast of curvature on the variable genes' graph, among those on the graphs of random panels of as many genes
    (meta.against_random), with n_coincident of the observed one, and n_panels, n_estimable of the random ones: a graph on which cells
    coincide gives no delta, and null is no panel. is_a: cell, is_a."""
    arms = pinned(is_a.select(F.col("cell").alias("id"), "is_a"), "arms")
    every = pinned(values.select("gene").distinct(), "genes")
    drawn = pinned(sampling.random_panels(every, "gene", size, panels), "panels")

    def delta(genes: DataFrame) -> DataFrame:
        listed = [r.gene for r in genes.orderBy("gene").collect()]  # size genes at most
        cells = pinned(normalize.principal_components(normalize.vectors(values, listed), n_components), "components")
        nodes, bad = node_curvature_or_none(cells, "cell", "pcs", k, n_edges)
        return _one_delta(_measured(nodes, arms, "id", F.col("is_a")), F.col("is_a"), bad)

    observed = delta(normalize.variable_genes(values, size).select("gene"))
    random = None
    for panel in range(panels):
        one = delta(drawn.where(F.col("panel") == panel).select("gene"))
        random = one if random is None else random.unionByName(one)
    observed, random = pinned(observed, "observed"), pinned(random, "random")
    of_random = random.agg(F.count("*").alias("n_panels"), F.count("delta").alias("n_estimable"))
    return meta.against_random(observed, random).crossJoin(observed.select("n_coincident")).crossJoin(of_random)  # a row each


def curvature_along_pseudotime(points: DataFrame, id_col: str, vector: str, root: int, group: str, k: int = 15, n_edges: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(rho, n) of curvature and pseudotime over the measured cells; and (group, n, mean_kappa, mean_pseudotime)."""
    nodes, _ = node_curvature(points, id_col, vector, k, n_edges)
    time = diffusion.pseudotime(points, id_col, vector, root)
    rows = pinned(_measured(nodes, points, id_col, F.col(group).alias("group")).join(time, "id"), "along")
    return effects.spearman(rows, "kappa", "pseudotime"), rows.groupBy("group").agg(F.count("*").alias("n"), F.avg("kappa").alias("mean_kappa"), F.avg("pseudotime").alias("mean_pseudotime"))


def extreme_subclones(rows: DataFrame, patient: str = "patient", clone: str = "subclone", value: str = "kappa", least: int = 10) -> DataFrame:
    """patient, n_subclones, highest, lowest, mean_highest, mean_lowest, delta: Cliff's delta of the subclone with the highest mean
    against that with the lowest, of patients with two subclones of least cells."""
    means = rows.groupBy(F.col(patient).alias("patient"), F.col(clone).alias("clone")).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where(F.col("n") >= least)
    ends = means.groupBy("patient").agg(F.count("*").alias("n_subclones"), F.max_by("clone", F.struct("m", "clone")).alias("highest"), F.min_by("clone", F.struct("m", "clone")).alias("lowest"), F.max("m").alias("mean_highest"), F.min("m").alias("mean_lowest")).where("n_subclones > 1")
    both = rows.select(F.col(patient).alias("patient"), F.col(clone).alias("clone"), F.col(value).alias("value")).join(ends.select("patient", "highest", "lowest"), "patient").where("clone = highest or clone = lowest")
    return ends.join(effects.mann_whitney(both, ["patient"], "value", F.col("clone") == F.col("highest")).select("patient", "delta"), "patient")


def pairwise(rows: DataFrame, group: str, value: str) -> DataFrame:
    """one, two, n1, n2, delta: Cliff's delta between every two of a few groups."""
    names = rows.select(F.col(group).alias("g")).where("g is not null").distinct()
    pairs = names.select(F.col("g").alias("one")).join(F.broadcast(names.select(F.col("g").alias("two"))), F.col("one") < F.col("two"))  # of a few groups
    both = rows.select(F.col(group).alias("g"), F.col(value).alias("value")).join(F.broadcast(pairs), (F.col("g") == F.col("one")) | (F.col("g") == F.col("two")))
    return effects.mann_whitney(both, ["one", "two"], "value", F.col("g") == F.col("one")).select("one", "two", "n1", "n2", "delta")


def response(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """arm (all for the whole), and arm_auc's row: a patient's mean curvature as a marker of response. cells: id, patient, arm, responded."""
    rows = nodes.where("status = 'measured'").select("id", "kappa").join(cells, "id")
    patients = pinned(rows.groupBy("patient").agg(F.avg("kappa").alias("kappa"), F.first("arm").alias("arm"), F.first("responded").alias("responded")), "patients")
    return effects.arm_auc(patients, "arm", "kappa", F.col("responded")).unionByName(effects.arm_auc(patients.withColumn("arm", F.lit("all")), "arm", "kappa", F.col("responded")))


def stratified_reruns(points: DataFrame, id_col: str, vector: str, depth: str, is_a: Column, k: int = 15, n_edges: int = 4000, bins: int = 5, least: int = 10, replicates: int = 400) -> DataFrame:
    """stratum, bin, n1, n2, delta, ci_lo, ci_hi: the contrast within bins of depth, and of the mean distance to the k neighbours."""
    nodes, _ = node_curvature(points, id_col, vector, k, n_edges)
    far = graph.mean_neighbour_distance(graph.neighbours(points, id_col, vector, k)).select(F.col("i").alias("id"), F.col("mean_d").alias("distance"))
    rows = pinned(_measured(nodes, points, id_col, F.col(depth).cast("double").alias("depth"), is_a.alias("is_a")).join(far, "id").select("id", "kappa", "is_a", "depth", "distance"), "rows")
    out = None
    for stratum in ("depth", "distance"):
        binned = pinned(labels.quantile_bin(rows, stratum, bins, "bin"), "binned")
        whole = effects.mann_whitney(binned, ["bin"], "kappa", F.col("is_a")).where((F.col("n1") >= least) & (F.col("n2") >= least)).select("bin", "n1", "n2", "delta")
        for b in range(bins):
            boot = meta.interval(meta.bootstrap_cliff_counts(binned.where(F.col("bin") == b), "kappa", F.col("is_a"), replicates)).select("ci_lo", "ci_hi")
            one = whole.where(F.col("bin") == b).crossJoin(boot).withColumn("stratum", F.lit(stratum))  # one row each
            out = one if out is None else out.unionByName(one)
    return out


def feature_sets(df: DataFrame, label: str, id_col: str, sets: dict[str, str], seeds: int = 10) -> DataFrame:
    """features, auc_mean, auc_std, ap_mean, f1_mean, n of the classifier on each set of features (name: array column)."""
    out = None
    for name, column in sets.items():
        one = ml.repeated_auc(df, label, id_col, column, seeds).withColumn("features", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def two_group(points: DataFrame, id_col: str, vector: str, is_a: Column, k: int = 15, n_edges: int = 4000, per_arm: int = 600, kind: str = "ollivier") -> DataFrame:
    """One cohort without patients: arms of equal size, curvature, Mann-Whitney and Cliff's delta."""
    arms = points.withColumn("arm", F.when(is_a, "a").otherwise("b"))
    chosen = pinned(sampling.independent_arms(arms, "arm", id_col, per_arm), "chosen")
    nodes, _ = node_curvature(chosen, id_col, vector, k, n_edges, kind=kind)
    rows = _measured(nodes, chosen, id_col, F.col("arm"))
    return effects.mann_whitney(rows, [], "kappa", F.col("arm") == "a")


def forman_against_ollivier(edges: DataFrame) -> DataFrame:
    """rho, n: rank correlation of the two curvatures over all edges."""
    kappa = curvature.ollivier_edges(edges)
    return effects.spearman(pinned(kappa.join(graph.forman(edges).select("u", "v", "forman"), ["u", "v"]), "curvatures"), "kappa", "forman")


def curvature_dimension(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """group, n, mean_k, mean_dimension over nodes (id, group)."""
    found = curvature.bakry_emery_nodes(edges, nodes)
    return found.join(nodes, "id").groupBy("group").agg(F.count("*").alias("n"), F.avg(F.element_at("curvature", -1)).alias("mean_k"), F.avg(F.when(~F.isnan("effective_dimension") & (F.col("effective_dimension") < F.lit(float("inf"))), F.col("effective_dimension"))).alias("mean_dimension"))


def by_depth(nodes: DataFrame, depth: DataFrame, is_a: Column, bins: int = 5, least: int = 10) -> DataFrame:
    """bin, n1, n2, delta: the contrast within bins of sequencing depth (id, depth)."""
    rows = labels.quantile_bin(nodes.where("status = 'measured'").join(depth, "id"), "depth", bins, "bin")
    return effects.mann_whitney(rows, ["bin"], "kappa", is_a).where((F.col("n1") >= least) & (F.col("n2") >= least)).select("bin", "n1", "n2", "delta")


def dual_graph(points: DataFrame, id_col: str, place: str, vector: str, is_a: Column, k_place: int = 6, k_vector: int = 15, n_edges: int = 4000) -> DataFrame:
    """graph, n1, n2, delta: the contrast on the graph of places and on that of expression."""
    out = None
    for name, column, k in (("physical", place, k_place), ("expression", vector, k_vector)):
        edges = pinned(graph.knn_graph(points, id_col, column, k, coincident="skip"), "edges")
        kappa = curvature.ollivier_edges(edges, sampling.sampled_edges(edges, n_edges))
        nodes = pinned(graph.node_summary(points.select(F.col(id_col).alias("id")), edges, kappa.select("u", "v", "kappa")), "nodes")
        rows = nodes.where("status = 'measured'").join(points.select(F.col(id_col).alias("id"), is_a.alias("is_a")), "id")
        one = effects.mann_whitney(rows, [], "kappa", F.col("is_a")).select(F.lit(name).alias("graph"), "n1", "n2", "delta")
        out = one if out is None else out.unionByName(one)
    return out


def subclone_contrast(scores: DataFrame, patient: str, id_col: str, features: str, value: str) -> DataFrame:
    """h, df, n: whether a value differs between Ward subclones of copy-number scores."""
    clones = pinned(ward.subclones(scores, patient, id_col, features), "clones")
    joined = scores.join(clones.select(id_col, "subclone"), id_col).withColumn("clone", F.concat_ws(":", F.col(patient).cast("string"), F.col("subclone").cast("string")))
    return effects.kruskal(joined, "clone", value)


def contact_curvature(contacts: DataFrame, floor: float = 1.5, n_edges: int = 4000) -> DataFrame:
    """chrom, n_edges, mean_kappa: curvature of each chromosome's contact graph, and of all edges under the name `all`.

    Chromosomes share no bin, so that all of them are one graph: a bin's node is its place behind those of the chromosomes before.
    """
    top = pinned(graph.contact_graph(contacts, floor), "contacts")
    spans = top.groupBy("chrom").agg((F.max("v") + 1).alias("bins"))
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)  # chromosomes: a small table
    offsets = spans.select("chrom", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("offset"))
    edges = pinned(top.join(offsets, "chrom").select("chrom", (F.col("u") + F.col("offset")).cast("long").alias("u"), (F.col("v") + F.col("offset")).cast("long").alias("v"), "weight"), "edges")
    chosen = edges.withColumn("h", draw(0, "edges", F.col("u"), F.col("v"))).withColumn("r", F.row_number().over(Window.partitionBy("chrom").orderBy("h", "u", "v"))).where(F.col("r") <= n_edges)
    measured = pinned(curvature.ollivier_edges(edges.drop("chrom"), chosen).join(edges.select("chrom", "u", "v"), ["u", "v"]), "measured")
    sums = [F.count("*").alias("n_edges"), F.avg("kappa").alias("mean_kappa")]
    return measured.groupBy("chrom").agg(*sums).unionByName(measured.agg(*sums).withColumn("chrom", F.lit("all")))


def from_counts(counts: DataFrame, n_genes: int = 200, n_components: int = 20, min_cells: int = 5) -> DataFrame:
    """cell, pcs: normalised counts, variable genes, principal components."""
    values = normalize.log_normalised(counts, 1e6, min_cells)
    genes = [r.gene for r in normalize.variable_genes(values, n_genes).collect()]
    return normalize.principal_components(normalize.vectors(values, genes), n_components)


def random_panels(values: DataFrame, is_a: Column, panels: DataFrame, observed: DataFrame) -> DataFrame:
    """An effect of the variable genes' mean score among those of random panels (panel, gene)."""
    scores = values.join(panels, "gene").groupBy("panel", "cell").agg(F.avg("value").alias("score"))
    return meta.against_random(observed, effects.mann_whitney(scores, ["panel"], "score", is_a).select("delta"))


def within_patients(rows: DataFrame, patient: str, value: str, is_a: Column, b: int = 400) -> DataFrame:
    """naive, coef, se, ci_lo, ci_hi, p, icc, shrinkage, delta, boot_lo, boot_hi, n, n_patients: the difference of the arms' means over
    all cells, that of a model with an intercept for each patient, by how many per cent it is smaller, and Cliff's delta over all
    cells with its bootstrapped interval."""
    rows = pinned(rows.select(F.col(patient).alias("patient"), F.col(value).cast("double").alias("value"), is_a.alias("is_a")).dropna(), "rows")
    means = rows.agg((F.avg(F.when(F.col("is_a"), F.col("value"))) - F.avg(F.when(~F.col("is_a"), F.col("value")))).alias("naive")).first()
    model = models.mixed_effect(rows, "patient", "value", F.col("is_a"))
    shown = {"naive": means.naive, **{c: model[c] for c in ("coef", "se", "ci_lo", "ci_hi", "p", "icc")}, "shrinkage": models.shrinkage(means.naive, model["coef"])}
    one = rows.sparkSession.createDataFrame([(*(None if v is None else float(v) for v in shown.values()), model["n"], model["n_patients"])], ", ".join(f"{c} double" for c in shown) + ", n long, n_patients long")
    delta = effects.mann_whitney(rows, [], "value", F.col("is_a")).select("delta")
    boot = meta.interval(meta.bootstrap_cliff_counts(rows, "value", F.col("is_a"), b)).select(F.col("ci_lo").alias("boot_lo"), F.col("ci_hi").alias("boot_hi"))
    return one.crossJoin(delta).crossJoin(boot)  # a row each


def by_donor(points: DataFrame, id_col: str, vector: str, specimen: str, donors: DataFrame, is_a: Column, **options) -> DataFrame:
    """patient_meta over donors: cells of specimens that the map (specimen, donor) covers, with unit, donor_verified, and how many
    specimens of either side have no partner. A specimen of two donors is an error."""
    if donors.groupBy("specimen").agg(F.count_distinct("donor").alias("n")).where("n <> 1").limit(1).count():
        raise ValueError("a specimen must have one donor")
    have = points.select(F.col(specimen).alias("specimen")).where("specimen is not null").distinct()
    walk = pinned(labels.crosswalk(have, donors.select("specimen", "donor").distinct()), "crosswalk")
    known = walk.where("covered").select(F.col("specimen").alias("__specimen"), "donor")
    cells = points.join(F.broadcast(known), F.col(specimen) == F.col("__specimen")).drop("__specimen")  # specimens: some hundred
    counts = walk.agg(F.count_if("covered").alias("n_covered"), F.count_if(~F.col("covered")).alias("n_uncovered"))
    return gates.donor_unit(patient_meta(cells, id_col, vector, "donor", is_a, **options).crossJoin(counts), donors)


def clonality_contrasts(nodes: DataFrame, cells: DataFrame, id_col: str, clone: str, threshold: int = 10) -> DataFrame:
    """one, two, n1, n2, delta: curvature of cells of expanded, other and non-expanded clones against each other."""
    groups = labels.clonality(cells, id_col, clone, threshold).select(F.col(id_col).alias("id"), "clonality")
    return pairwise(pinned(nodes.where("status = 'measured'").select("id", "kappa").join(groups, "id"), "clones"), "clonality", "kappa")


def decomposition(points: DataFrame, id_col: str, vector: str, cohort: str, schemes: dict[str, Column], **options) -> DataFrame:
    """cohort and label_validation's rows: how labelling schemes contrast over the geometry of each cohort, measured once."""
    out = None
    for (c,) in sorted(points.select(cohort).where(F.col(cohort).isNotNull()).distinct().collect()):  # a few cohorts
        found, _ = label_validation(pinned(points.where(F.col(cohort) == c), "cohort"), id_col, vector, schemes, **options)
        found = found.withColumn("cohort", F.lit(c))
        out = found if out is None else out.unionByName(found)
    return out


def dimension_and_curvature(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """rho, n: rank correlation of a node's curvature, at the last of its dimensions, and its effective dimension, where both are finite."""
    found = curvature.bakry_emery_nodes(edges, nodes).select(F.element_at("curvature", -1).alias("curvature"), F.col("effective_dimension").alias("dimension"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return effects.spearman(pinned(found.where(finite("curvature") & finite("dimension")), "found"), "curvature", "dimension")


def arm_clones(values: DataFrame, genes: DataFrame, reference: DataFrame, patients: DataFrame, nodes: DataFrame, most: int = 5, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(h, df, n) of curvature over the Ward clusters of each patient's arm scores, null and 0 where no curvature is measured, and extreme_subclones' rows. patients: cell, patient;
    nodes: id, kappa, status."""
    scores = normalize.arm_scores(values, genes, reference)
    cells = scores.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("arm", "score"))), lambda e: e["score"]).alias("scores"))  # arms: some forty
    rows = pinned(cells.join(patients, "cell"), "scores")
    clones = ward.subclones(rows, "patient", "cell", "scores", most, least)
    joined = pinned(nodes.where("status = 'measured'").select(F.col("id").alias("cell"), "kappa").join(clones.withColumnRenamed("patient", "p"), "cell").select("cell", "kappa", F.col("p").alias("patient"), "subclone"), "clones")
    named = joined.withColumn("clone", F.concat_ws(":", F.col("patient").cast("string"), F.col("subclone").cast("string")))
    found = effects.kruskal(named, "clone", "kappa").select("h", F.when(F.col("n") > 0, F.col("df")).alias("df"), F.coalesce("n", F.lit(0)).alias("n"))
    return found, extreme_subclones(joined, least=least)


def classifier_by_cohort(points: DataFrame, id_col: str, vector: str, cohort: str, label: Column, k: int = 15, n_edges: int = 4000, kind: str = "ollivier") -> DataFrame:
    """cohort, features, n_train, n_test, auc, ap, accuracy, f1: each cohort's cells scored by a model of the other cohorts, from the
    embedding and from curvature and degree in the graph of its own cohort."""
    out = None
    for (c,) in sorted(points.select(cohort).where(F.col(cohort).isNotNull()).distinct().collect()):  # a few cohorts
        cells = pinned(points.where(F.col(cohort) == c), "cohort")
        nodes, _ = node_curvature(cells, id_col, vector, k, n_edges, kind=kind)
        one = _measured(nodes, cells, id_col, F.col(cohort).alias("cohort"), label.alias("y"), F.col(vector).cast("array<double>").alias("embedding"))
        one = one.select("id", "cohort", "y", "embedding", F.array("kappa", F.col("degree").cast("double")).alias("curvature"))
        out = one if out is None else out.unionByName(one)
    rows = pinned(out, "rows")
    found = [ml.leave_one_group_out(rows, "cohort", "y", c).withColumn("features", F.lit(c)) for c in ("embedding", "curvature")]
    return found[0].unionByName(found[1])
