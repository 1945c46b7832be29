"""Whole analyses on small cases with known answers, and the gates on published results."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import verify
from orrery.operators import batches, curvature, diffusion, gates, graph, meta, ml, models, normalize, sampling
from orrery.plans import composites
from orrery.sources import counts, results


@pytest.fixture(scope="module")
def points(spark):
    """Two clouds, one tight and one loose, in four patients."""
    rng = np.random.default_rng(3)
    rows = [(i, (i // 2) % 4, i % 2, (rng.normal(size=4) * (0.3 if i % 2 else 1.0) + 6 * (i % 2)).tolist(), float(rng.uniform(1, 9))) for i in range(160)]
    return spark.createDataFrame(rows, "id long, patient long, label long, x array<double>, depth double").persist()


def first_arm():
    return F.col("label") == 1


def cliff(a, b):
    return np.sign(np.subtract.outer(a, b)).mean()


def test_flagship_against_its_parts(spark, points):
    """The sampler's cells, a graph of them, curvature of its edges, means by node, contrasts, pooling: each by a plain loop."""
    got = composites.patient_meta(points, "id", "x", "patient", first_arm(), k=5, min_cells=10, cap=15, replicates=50).first()
    chosen = {r.id: (r.patient, r.arm) for r in sampling.stratified_minima_first(points, "patient", "id", first_arm(), ~first_arm(), 10, 15, 3500).collect()}
    x = {r.id: np.array(r.x) for r in points.collect() if r.id in chosen}
    assert len(chosen) == 4 * 2 * 15
    edges = set()
    for i in x:
        for j in sorted((j for j in x if j != i), key=lambda j: (np.linalg.norm(x[i] - x[j]), j))[:5]:
            edges.add((min(i, j), max(i, j)))
    whole = curvature.Graph(*(np.array(c) for c in zip(*((u, v, float(np.linalg.norm(x[u] - x[v]))) for u, v in sorted(edges)))))
    at = {}
    for u, v in edges:
        kappa = curvature.ollivier(whole, u, v)[0]
        at.setdefault(u, []).append(kappa)
        at.setdefault(v, []).append(kappa)
    mean = {i: np.mean(k) for i, k in at.items()}
    effects = []
    for p in range(4):
        a, b = ([mean[i] for i, (q, arm) in chosen.items() if q == p and arm == side] for side in "ab")
        signs = np.sign(np.subtract.outer(a, b))
        effects.append((signs.mean(), np.sqrt(signs.mean(axis=1).var(ddof=1) / len(a) + signs.mean(axis=0).var(ddof=1) / len(b))))
    usable = [(d, s) for d, s in effects if s > 0]
    pooled = meta.dersimonian_laird(spark.createDataFrame([(float(d), float(s)) for d, s in usable], "delta double, se double")).first()
    assert got.k == len(usable) and got.delta == pytest.approx(pooled.delta, abs=1e-9) and got.se == pytest.approx(pooled.se, abs=1e-9)
    assert got.replicates == 50 and got.boot_lo <= got.boot_mean <= got.boot_hi and got.status == "INSUFFICIENT_PATIENTS"


def test_variants_of_cells_with_two_labels(spark, points):
    marks = points.select(F.col("id").alias("barcode"), F.when(first_arm(), "malignant").otherwise("immune").alias("label"))
    both = marks.unionByName(points.where("id < 8").select(F.col("id").alias("barcode"), F.when(first_arm(), "immune").otherwise("malignant").alias("label")))
    got = {r.variant: r for r in composites.dual_label_variants(points.drop("label"), "id", "x", "patient", both, k=5, min_cells=5, cap=20, replicates=5).collect()}
    assert set(got) == {"excluded", "dual_mal", "dual_immune"}
    alone = composites.patient_meta(points.where("id >= 8"), "id", "x", "patient", first_arm(), k=5, min_cells=5, cap=20, replicates=5).first()
    assert got["excluded"].delta == pytest.approx(alone.delta, abs=1e-12)


def test_labels_over_one_geometry(points):
    rows, verdict = composites.label_validation(points, "id", "x", {"true": first_arm(), "same": first_arm(), "none": F.col("id") % 4 < 2}, 5, 400, 10)
    found = {r.scheme: r for r in rows.collect()}
    assert found["true"].delta == found["same"].delta and abs(found["true"].delta) > abs(found["none"].delta)
    assert verdict.first().n_classified == 3


def test_embeddings_against_each_other(points):
    rows, verdict = composites.embeddings_against(points, "id", "x", "patient", "depth", first_arm(), 5, 300, 2)
    assert sorted(r["method"] for r in rows.collect()) == ["corrected", "depth", "original", "random", "random"]
    assert verdict.first().verdict in {"KILLED", "WEAKENED", "NULL-MATCHED", "DEPTH-CONFOUNDED", "SURVIVES"}


def test_grid_and_panels(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(c, g, float(rng.poisson(3 + 5 * (g < 10 and c % 2)))) for c in range(40) for g in range(60)], "cell long, gene long, value double").where("value > 0").persist()
    arms = spark.range(40).select(F.col("id").alias("cell"), (F.col("id") % 2 == 1).alias("is_a"))
    grid, verdict, axes = composites.parameter_grid(table, arms, [20, 40], [3], [4], [0.0, 0.5], 100)
    assert grid.count() == 4 and verdict.first().n == 4 and {r.axis for r in axes.collect()} == {"genes", "components", "k", "alpha"}
    assert composites.curvature_of_panels(table, arms, 20, 3, 3, 4, 100).first().mean is not None


def test_coincident_cells_are_reported_as_not_estimable(spark):
    """Two cells of one profile: no delta, their number, and no error; the other analyses of a table go on."""
    rng = np.random.default_rng(5)
    rows = [(c, g, float(rng.poisson(3 + 5 * (g < 10 and c % 2)))) for c in range(40) for g in range(60)]
    table = spark.createDataFrame(rows + [(40, g, x) for c, g, x in rows if c == 7], "cell long, gene long, value double").where("value > 0").persist()
    arms = spark.range(41).select(F.col("id").alias("cell"), (F.col("id") % 2 == 1).alias("is_a"))
    grid, verdict, _ = composites.parameter_grid(table, arms, [20, 40], [3], [4], [0.0, 0.5], 100)
    assert [(r.delta, r.n_coincident) for r in grid.collect()] == [(None, 2)] * 4 and verdict.first().n == 0
    got = composites.curvature_of_panels(table, arms, 20, 3, 3, 4, 100).first()
    assert (got.value, got.mean, got.n_coincident, got.n_panels, got.n_estimable) == (None, None, 2, 3, 0)
    one = table.where("cell < 40")
    got = composites.curvature_of_panels(one, arms, 20, 3, 3, 4, 100).first()
    assert got.value is not None and (got.n_coincident, got.n_panels, got.n_estimable) == (0, 3, 3)
    nodes, bad = composites.node_curvature_or_none(spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [2.0])], "id long, x array<double>"), "id", "x", 1)
    assert bad == 2 and {(r.status, r.kappa) for r in nodes.collect()} == {("non_estimable_coincident", None)}


def test_contacts_of_all_chromosomes_are_one_graph(spark):
    rng = np.random.default_rng(1)
    rows = [(f"chr{c}", i, j, float(rng.poisson(400 / (j - i + 1)) + 1)) for c in range(2) for i in range(25) for j in range(i, 25)]
    contacts = spark.createDataFrame(rows, "chrom string, i long, j long, count double")
    got = {r.chrom: r for r in composites.contact_curvature(contacts, 0.9, 30).collect()}
    top = graph.contact_graph(contacts, 0.9)
    for c in ("chr0", "chr1"):
        edges = top.where(F.col("chrom") == c).select("u", "v", "weight")
        assert got[c].n_edges == min(30, edges.count())
    whole = {r.chrom: r for r in composites.contact_curvature(contacts, 0.9).collect()}
    for c in ("chr0", "chr1"):
        edges = top.where(F.col("chrom") == c).select("u", "v", "weight")
        alone = curvature.ollivier_edges(edges).agg(F.avg("kappa")).first()[0]
        assert whole[c].mean_kappa == pytest.approx(alone, abs=1e-12)
    assert whole["all"].n_edges == whole["chr0"].n_edges + whole["chr1"].n_edges


def test_extreme_subclones_and_pairs(spark):
    rows = [(p, c, float(10 * c + i % 3)) for p in (1, 2) for c in (0, 1, 2) for i in range(12 if c < 2 or p == 1 else 3)]
    table = spark.createDataFrame(rows, "patient long, subclone long, kappa double")
    got = {r.patient: r for r in composites.extreme_subclones(table).collect()}
    assert (got[1].highest, got[1].lowest, got[1].delta, got[1].n_subclones) == (2, 0, 1.0, 3) and got[2].highest == 1
    pairs = {(r.one, r.two): r.delta for r in composites.pairwise(table.where("patient = 1"), "subclone", "kappa").collect()}
    assert pairs == {(0, 1): -1.0, (0, 2): -1.0, (1, 2): -1.0}


def test_reruns_within_strata(points):
    got = composites.stratified_reruns(points, "id", "x", "depth", first_arm(), 5, 400, 2, 5, 20).collect()
    assert {(r.stratum, r.bin) for r in got} <= {(s, b) for s in ("depth", "distance") for b in (0, 1)} and got
    assert all(r.ci_lo <= r.ci_hi for r in got)


def test_curvature_along_pseudotime(points):
    rho, groups = composites.curvature_along_pseudotime(points.where("id < 80"), "id", "x", 0, "label", 5, 100)
    assert -1 <= rho.first().rho <= 1 and {r.group for r in groups.collect()} == {0, 1}


# Gates


def test_a_pooled_result_is_held_against_its_table(spark, tmp_path, capsys):
    effects = spark.createDataFrame([(0.2, 0.1), (0.3, 0.15), (-0.1, 0.2)], "delta double, se double")
    claimed = {k: v for k, v in meta.dersimonian_laird(effects).first().asDict().items() if k in ("k", "delta", "se", "ci_lo", "ci_hi", "z", "q", "df", "tau2", "i2")}
    gates.verify_pooled(effects, claimed)
    for wrong in ({**claimed, "delta": claimed["delta"] * 1.001}, {k: v for k, v in claimed.items() if k != "q"}):
        with pytest.raises(gates.GateError):
            gates.verify_pooled(effects, wrong)
    table, result = str(tmp_path / "effects.parquet"), tmp_path / "result.json"
    effects.write.parquet(table)
    result.write_text(json.dumps(claimed))
    assert verify.main([table, str(result)]) == 0
    result.write_text(json.dumps({**claimed, "k": 4}))
    assert verify.main([table, str(result)]) == 1 and "k" in capsys.readouterr().err
    assert verify.main([str(tmp_path / "none.parquet"), str(result)]) == 2 and verify.main([]) == 2


def test_only_one_field_may_differ():
    one = {"a": 1, "b": {"c": 2.0, "d": 3}}
    gates.only_field(one, {"a": 1, "b": {"c": 2.5, "d": 3}}, "b/c")
    for other in ({"a": 1, "b": {"c": 2.0, "d": 3}}, {"a": 2, "b": {"c": 2.5, "d": 3}}, {"a": 1, "b": {"c": 2.5}}):
        with pytest.raises(gates.GateError):
            gates.only_field(one, other, "b/c")


def test_files_that_cannot_be_read_say_so(spark, tmp_path):
    for read in (counts.read_hdf5, counts.read_rds):
        with pytest.raises(counts.SourceError, match="not read"):
            read(spark, "x")
    results.write_table(spark.range(5).withColumn("s", F.lit("a")), str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), sep="\t", header=True)
    assert {r.id for r in back.collect()} == set("01234")


# Numbers of operators that SQL cannot say


def test_components_against_singular_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    got = {r.cell: r.pcs for r in normalize.principal_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, features array<double>"), 3).collect()}
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert np.array([got[i] for i in range(50)]) == pytest.approx(centred @ axes, abs=1e-8)


def test_batches_come_together_and_groups_stay_apart(spark):
    rng = np.random.default_rng(4)
    group, batch = np.arange(120) % 2, np.arange(120) // 60
    x = rng.normal(size=(120, 3)) * 0.3 + np.outer(group, [6, 0, 0]) + [4, 4, 4] + np.outer(batch, [0, 1.5, 0])
    rows = spark.createDataFrame([(i, str(batch[i]), x[i].tolist()) for i in range(120)], "id long, b string, x array<double>")
    y = np.array([r.features for r in batches.batch_corrected(rows, "id", "b", "x", clusters=4).orderBy("id").collect()])
    apart = lambda z, by: np.abs(z[by == 1].mean(axis=0) - z[by == 0].mean(axis=0)).max()
    assert apart(y, batch) < 0.3 * apart(x, batch) and apart(y, group) > 0.8 * apart(x, group)


def test_pseudotime_along_a_line(spark):
    rows = spark.createDataFrame([(i, [i / 10.0, 0.0]) for i in range(60)], "id long, x array<double>")
    got = [r.pseudotime for r in diffusion.pseudotime(rows, "id", "x", 0, k=5).orderBy("id").collect()]
    assert got[0] == 0 and max(got) == 1 and all(a < b for a, b in zip(got, got[1:]))


def test_logit_against_its_equations(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2))
    y = rng.uniform(size=200) < 1 / (1 + np.exp(-(0.5 + x[:, 0])))
    out = models.logit(spark.createDataFrame([(int(b), float(a[0]), float(a[1])) for b, a in zip(y, x)], "y int, a double, b double"), "y", ["a", "b"])
    p = 1 / (1 + np.exp(-(out["coef"]["intercept"] + x @ [out["coef"]["a"], out["coef"]["b"]])))
    assert np.abs((y - p) @ np.column_stack([np.ones(200), x])).max() < 1e-8
    assert out["log_likelihood"] == pytest.approx(np.log(np.where(y, p, 1 - p)).sum()) and out["log_likelihood_null"] == pytest.approx(200 * (y.mean() * np.log(y.mean()) + (1 - y.mean()) * np.log(1 - y.mean())))
    assert out["llr_p"] == pytest.approx(np.exp(-(out["log_likelihood"] - out["log_likelihood_null"])))  # two degrees of freedom


def test_leave_one_out_is_a_model_of_the_others(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, bool(i % 2), (rng.normal(size=3) + 2 * (i % 2)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, cohort long, y boolean, x array<double>")
    got = {r.cohort: r for r in ml.leave_one_group_out(df, "cohort", "y", "x").collect()}
    for c in range(3):
        one = ml.scores_of(ml.logistic_scores(df.where(F.col("cohort") != c), df.where(F.col("cohort") == c), "y", "x"), "y").first()
        assert (got[c].n_train, got[c].n_test) == (60, 30) and got[c].auc == pytest.approx(one.auc) and got[c].auc > 0.9
    runs = ml.repeated_auc(df, "y", "id", "x", 3).first()
    each = [ml.scores_of(ml.logistic_scores(s.where("not test"), s.where("test"), "y", "x"), "y").first().auc for s in (ml.stratified_split(df, "y", "id", 0.2, k) for k in (1, 2, 3))]
    assert runs.auc_mean == pytest.approx(np.mean(each)) and runs.auc_std == pytest.approx(np.std(each)) and runs.n == 3


def test_files_that_depend_on_their_content_alone(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 0.5), (1, "a", 1.5)], "k int, s string, v double")
    one, two = (results.write_sorted_tsv(t, str(tmp_path / f"{i}.tsv.gz"), ["k"]) for i, t in enumerate((df, df.orderBy("v", ascending=False).repartition(3))))
    assert one == two
    with gzip.open(tmp_path / "0.tsv.gz", "rt") as f:
        assert f.read() == "k\ts\tv\n1\ta\t1.5\n2\t\t0.5\n"


def test_runs_are_blocked_without_inputs_and_reproduced_with_them(tmp_path):
    out, here = str(tmp_path / "out.json"), tmp_path / "in"
    assert results.run_or_block({"counts": str(here)}, out, lambda: {"x": 1}) == 2
    assert results.read_json(out) == {"status": "blocked", "missing": ["counts"]}
    here.write_text("x")
    assert results.run_or_block({"counts": str(here)}, out, lambda: {"x": float("nan")}) == 0 and results.read_json(out) == {"status": "ok", "x": None}
    kept = str(tmp_path / "kept.json")
    assert results.reproduced(kept, {"a": 1.0, "seconds": 3}) and results.reproduced(kept, {"a": 1.0, "seconds": 9})
    assert not results.reproduced(kept, {"a": 1.1, "seconds": 3}) and results.reproduced(kept, {"a": 1.05, "seconds": 3}, 0.1)
    assert results.reproduced(kept, {"a": 2.0}, update=True) and results.reproduced(kept, {"a": 2.0})


def test_gates_that_check_nothing_do_not_pass(spark):
    for report in (spark.createDataFrame([(3,)], "n_rows int"), spark.createDataFrame([], "n_bad_x int")):
        with pytest.raises(gates.GateError, match="nothing"):
            gates.enforce(report, "labels")
    gates.require_all({"delta": True, "k": 1})
    for checks in ({}, {"delta": True, "p": False}):
        with pytest.raises(gates.GateError):
            gates.require_all(checks, "run")


def test_tails_are_compared_by_their_logarithms():
    assert gates.compare_tail("p", 0.0, 0.0) == [] == gates.compare_tail("p", 1e-300, 1e-300 * (1 + 1e-9))
    for one, other in ((1e-300, 2e-300), (0.0, 1e-300), (0.04, 0.0401), (0.5, None), (1.5, 1.5)):
        assert gates.compare_tail("p", one, other)


def test_published_fields_and_patients_are_verified(spark):
    effects = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.3, 0.15), ("c", -0.1, 0.2)], "patient_id string, delta double, se double")
    made = meta.with_tails(meta.dersimonian_laird(effects)).first().asDict()
    published = {"k": made["k"], "Q": made["q"], "I2": made["i2"], "pQ": made["p_q"], "delta_FE": made["delta_fe"], "note": "more", **{f: made[f] for f in ("delta", "se", "ci_lo", "ci_hi", "z", "p", "df", "tau2")}}
    gates.verify_pooled(effects, published, whole=True, expected=effects.select("patient_id"))
    for field, wrong in (("p", made["p"] * 1.001), ("pQ", made["p_q"] / 1.01), ("delta_FE", made["delta_fe"] + 1e-4), ("tau2", None)):
        with pytest.raises(gates.GateError):
            gates.verify_pooled(effects, {**published, field: wrong}, whole=True)
    with pytest.raises(gates.GateError, match="has no"):
        gates.verify_pooled(effects, {k: v for k, v in published.items() if k != "pQ"}, whole=True)
    for rows in (effects.unionByName(effects), effects.withColumn("patient_id", F.lit(None).cast("string"))):
        with pytest.raises(gates.GateError, match="patients"):
            gates.verify_pooled(rows, published)
    with pytest.raises(gates.GateError, match="patients"):
        gates.verify_pooled(effects, published, expected=effects.limit(2))
    one = effects.limit(1)
    single = meta.with_tails(meta.dersimonian_laird(one)).first().asDict()
    gates.verify_pooled(one, {f: single[f] for f in (*gates.POOLED, *gates.TESTED)}, whole=True)


# Donors, cohorts, clones


def test_what_patients_explain_is_taken_off_the_contrast(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p, (n_a, n_b) in enumerate([(40, 8), (30, 10), (10, 35), (6, 44), (20, 20), (38, 9)]):
        level = 4.0 if n_a > n_b else 0.0  # patients with more of the first arm lie higher
        rows += [(p, True, level + 0.5 + rng.normal()) for _ in range(n_a)] + [(p, False, level + rng.normal()) for _ in range(n_b)]
    rows.append((9, None, 1.0))
    got = composites.within_patients(spark.createDataFrame(rows, "p int, a boolean, v double"), "p", "v", F.col("a"), 200).first()
    values = {arm: np.array([v for _, a, v in rows if a is arm]) for arm in (True, False)}
    assert got.naive == pytest.approx(values[True].mean() - values[False].mean()) and got.n == len(rows) - 1 and got.n_patients == 6
    assert got.naive > 1.5 and abs(got.coef - 0.5) < 3 * got.se and got.shrinkage == pytest.approx(100 * (1 - got.coef / got.naive)) and got.icc > 0.5
    assert got.delta == pytest.approx(np.sign(np.subtract.outer(values[True], values[False])).mean()) and got.boot_lo < got.delta < got.boot_hi


def test_a_specimen_has_one_donor(spark, points):
    p = points.withColumn("specimen", F.col("id") % 4)
    with pytest.raises(ValueError, match="one donor"):
        composites.by_donor(p, "id", "x", "specimen", spark.createDataFrame([(0, 1), (0, 2)], "specimen long, donor long"), F.col("label") == 1)


def test_clones_of_arm_scores_and_their_extremes(spark):
    """Two clones a patient, one with a gain of arm B, whose curvature is higher."""
    rng = np.random.default_rng(2)
    genes = [(g, "A" if g < 30 else "B", g) for g in range(60)]
    cells = [(c, c % 2, (c // 2) % 2) for c in range(80)]  # cell, patient, clone
    values = [(c, g, float(rng.normal(5, 0.2) + (2.0 if k and g >= 30 else 0))) for c, _, k in cells for g, _, _ in genes]
    reference = spark.createDataFrame([(1000 + i,) for i in range(10)], "cell long")
    values += [(1000 + i, g, float(rng.normal(5, 0.2))) for i in range(10) for g, _, _ in genes]
    nodes = spark.createDataFrame([(c, 0.1 * c / 80 + (1.0 if k else 0.0), "measured") for c, _, k in cells], "id long, kappa double, status string")
    h, extremes = composites.arm_clones(spark.createDataFrame(values, "cell long, gene long, value double"), spark.createDataFrame(genes, "gene long, arm string, start long"), reference, spark.createDataFrame([(c, p) for c, p, _ in cells], "cell long, patient long"), nodes, 2, 5)
    found = {r.patient: r for r in extremes.collect()}
    assert set(found) == {"0", "1"} or set(found) == {0, 1}
    assert all(r.delta == 1.0 and r.n_subclones == 2 and r.mean_highest - r.mean_lowest == pytest.approx(1, abs=0.1) for r in found.values())
    assert h.first().df == 3 and h.first().h > 50


def test_cohorts_are_scored_by_models_of_the_others(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, bool(i // 3 % 2), [float(x) for x in rng.normal(3.0 * (i // 3 % 2), 1, 4)]) for i in range(150)]
    got = composites.classifier_by_cohort(spark.createDataFrame(rows, "id long, cohort int, y boolean, x array<double>"), "id", "x", "cohort", F.col("y"), 5, kind="forman").collect()
    assert sorted((r.cohort, r.features) for r in got) == sorted((c, f) for c in range(3) for f in ("embedding", "curvature"))
    assert all(r.n_test == 50 and r.n_train == 100 for r in got) and min(r.auc for r in got if r.features == "embedding") > 0.95


def test_rank_correlation_of_curvature_and_dimension(spark, points):
    edges = graph.knn_graph(points.where("id < 60"), "id", "x", 5)
    nodes = points.where("id < 60").select("id", F.col("label").alias("group"))
    rho = composites.dimension_and_curvature(edges, nodes).first()
    pairs = [(r.curvature[-1], r.effective_dimension) for r in curvature.bakry_emery_nodes(edges, nodes).collect()]
    pairs = np.array([p for p in pairs if np.isfinite(p).all()])
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert rho.n == len(pairs) and rho.rho == pytest.approx(np.corrcoef(rank(pairs[:, 0]), rank(pairs[:, 1]))[0, 1])
