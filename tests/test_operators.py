import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import effects, gates, graph, labels, meta, ml, models, normalize, sampling
from orrery.sources import counts, results

def arm():
    return F.col("arm") == "a"


def arms(spark, a, b, key=0):
    return spark.createDataFrame([(key, "a", float(x)) for x in a] + [(key, "b", float(x)) for x in b], "k int, arm string, v double")


def test_cliff_equals_the_dominance_matrix(spark):
    a, b = [1, 1, 2, 3], [1, 2, 2, 4]
    sign = [[(x > y) - (x < y) for y in b] for x in a]
    row = effects.cliff_delta(arms(spark, a, b), ["k"], "v", arm()).first()
    assert row.delta == pytest.approx(sum(map(sum, sign)) / 16)
    g1, g2 = [sum(r) / 4 for r in sign], [sum(c) / 4 for c in zip(*sign)]
    var = lambda g: sum((x - sum(g) / 4) ** 2 for x in g) / 3
    assert row.se == pytest.approx(math.sqrt(var(g1) / 4 + var(g2) / 4)) and row.status == "ok"


def test_cliff_says_why_it_has_no_error(spark):
    row = effects.cliff_delta(arms(spark, [3, 4], [1, 2]), ["k"], "v", arm()).first()
    assert (row.delta, row.se, row.status) == (1.0, None, "non_estimable_degenerate_projection")
    assert effects.cliff_delta(arms(spark, [3], [1, 2]), ["k"], "v", arm()).first().status == "non_estimable_small_group"
    assert effects.cliff_delta(arms(spark, [], [1.0]), ["k"], "v", arm()).count() == 0


def test_meta_of_one_and_several_studies(spark):
    one = meta.dersimonian_laird(spark.createDataFrame([(0.4, 0.2)], "delta double, se double")).first()
    assert (one.k, one.q, one.tau2) == (1, None, None) and one.delta == pytest.approx(0.4)
    rows = spark.createDataFrame([(0.1, 0.1), (0.5, 0.2), (0.3, 0.1)], "delta double, se double")
    got = meta.with_tails(meta.dersimonian_laird(rows)).first()
    w = [100, 25, 100]
    fixed = sum(x * d for x, d in zip(w, (0.1, 0.5, 0.3))) / 225
    q = sum(x * (d - fixed) ** 2 for x, d in zip(w, (0.1, 0.5, 0.3)))
    assert got.q == pytest.approx(q) and got.delta_fe == pytest.approx(fixed)
    assert got.tau2 == pytest.approx(max(0, (q - 2) / (225 - sum(x * x for x in w) / 225)))
    tiny = meta.with_tails(meta.dersimonian_laird(spark.createDataFrame([(0.6, 0.01)] * 30, "delta double, se double"))).first()
    assert tiny.log_p < -690 and math.isfinite(tiny.log_p)


def test_meta_refuses_bad_input(spark):
    with pytest.raises(Exception, match="effects must lie"):
        meta.check_effects(spark.createDataFrame([(0.5, 0.0)], "delta double, se double")).collect()


@pytest.mark.parametrize("k, delta, p, status", [(3, 0.5, 0.01, "INSUFFICIENT_PATIENTS"), (6, 0.5, 0.01, "SUPPORTED"), (6, -0.5, 0.99, "NOT_SUPPORTED"), (6, 1.5, 0.01, "INVALID_NUMERICS")])
def test_decisions(spark, k, delta, p, status):
    row = meta.protocol_decision(spark.createDataFrame([(k, delta, p)], "k long, delta double, one_sided_p double")).first()
    assert row.status == status and row.supported == (None if status.startswith("IN") else status == "SUPPORTED")


def test_an_analysis_with_a_failed_check_is_invalid(spark):
    assert meta.protocol_decision(spark.createDataFrame([(9, 0.5, 0.01)], "k long, delta double, one_sided_p double"), donors_verified=False).first().status == "INVALID_ANALYSIS"


def test_sampler_keeps_minima_and_its_total(spark):
    rows = spark.createDataFrame([(p, i, i % 2) for p in range(4) for i in range(1000 * p, 1000 * p + (60 if p else 8))], "patient int, id int, arm int")
    got = sampling.stratified_minima_first(rows, "patient", "id", F.col("arm") == 0, F.col("arm") == 1, 10, 25, 100).collect()
    assert len(got) == 100 and {r.patient for r in got} == {1, 2, 3}
    for p in (1, 2, 3):
        for arm in "ab":
            assert 10 <= sum(r.patient == p and r.arm == arm for r in got) <= 25
    with pytest.raises(Exception, match="minima"):
        sampling.stratified_minima_first(rows, "patient", "id", F.col("arm") == 0, F.col("arm") == 1, 10, 25, 50).collect()


def test_normalisation_divides_by_the_full_library(spark):
    rows = spark.createDataFrame([("c1", "g1", 9.0), ("c2", "g1", 9.0), ("c1", "g2", 1.0), ("c2", "g3", 1.0)], "cell string, gene string, value double")
    got = normalize.log_normalised(rows, 100, 2).collect()
    assert {r.gene for r in got} == {"g1"} and [r.value for r in got] == pytest.approx([math.log(91)] * 2)


def test_knn_graph_of_a_pentagon_and_coincident_points(spark):
    points = [(i, [math.cos(2 * math.pi * i / 5), math.sin(2 * math.pi * i / 5)]) for i in range(5)]
    edges = graph.knn_graph(spark.createDataFrame(points, "id long, x array<double>"), "id", "x", 2)
    assert {(r.u, r.v) for r in edges.collect()} == {(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)}
    with pytest.raises(Exception, match="coincident"):
        graph.knn_graph(spark.createDataFrame([(0, [1.0]), (1, [1.0])], "id long, x array<double>"), "id", "x", 1).collect()


def test_blocked_neighbours_are_the_same(spark, monkeypatch):
    import random

    rng = random.Random(1)
    points = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(300)], "id long, x array<double>")
    small = sorted((r.i, r.j, r.r) for r in graph.neighbours(points, "id", "x", 3).collect())
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "BLOCK", 64)
    assert sorted((r.i, r.j, r.r) for r in graph.neighbours(points, "id", "x", 3).collect()) == small


def test_blocked_neighbours_move_a_table_a_group_not_a_block(spark, monkeypatch):
    """64 blocks of which every two meet: the vectors are written some times, not 64 times."""
    import random

    rng = random.Random(4)
    points = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(2048)], "id long, x array<double>")
    small = sorted((r.i, r.j, r.r) for r in graph.neighbours(points, "id", "x", 3).collect())
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "BLOCK", 32)
    context = spark.sparkContext._jsc.sc()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as larger tables are joined

    def written():
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    try:
        assert sorted((r.i, r.j, r.r) for r in graph.neighbours(points, "id", "x", 3).collect()) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert written() - before < 20 * 2048 * 16 * 8


def test_ties_of_millions_of_rows(spark):
    """t^3 - t is beyond 64 bits."""
    from orrery.operators import effects

    n = 3_000_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.lit(2.0).alias("x"), F.lit(1.0).alias("y"), (F.col("id") % 2 == 0).alias("a"))
    assert effects.wilcoxon(rows, ["k"], "x", "y").first().ties == float(n**3 - n)
    assert effects.mann_whitney(rows, [], "x", F.col("a")).first().ties == float(n**3 - n)
    assert effects.kruskal(rows, "a", "x").first().n == n


def test_an_edge_measured_twice_is_an_error(spark):
    nodes, edges = spark.createDataFrame([(0,), (1,)], "id long"), spark.createDataFrame([(0, 1, 1.0)], "u long, v long, weight double")
    twice = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "u long, v long, kappa double")
    with pytest.raises(Exception, match="twice"):
        graph.node_summary(nodes, edges, twice).collect()


def test_mixed_model_finds_the_effect(spark):
    import random

    rng = random.Random(2)
    rows = [(p, i % 2, rng.gauss(0, 1) + 0.7 * (i % 2) + shift) for p, shift in ((p, rng.gauss(0, 2)) for p in range(30)) for i in range(40)]
    got = models.mixed_effect(spark.createDataFrame(rows, "p int, x int, y double"), "p", "y", F.col("x") == 1)
    assert abs(got["coef"] - 0.7) < 3 * got["se"] and 0.5 < got["icc"] < 0.95


def test_gates(spark):
    rows = spark.createDataFrame([("b1", "s1", "007", "x"), ("b1", "s2", "007", "x"), ("b2", "s1", "1", "x")], "barcode string, sample string, patient string, label string")
    report = gates.label_identity(rows)
    assert report.first().n_bad_sample == 1
    with pytest.raises(gates.GateError):
        gates.enforce(report, "labels")
    assert gates.compare({"a": 1.0, "log_p": -500.0}, {"a": 1.0 + 1e-12, "log_p": -500.0}, 1e-9) == []
    assert gates.compare({"a": 1}, {"a": 1, "b": 2}) and gates.compare({"a": math.nan}, {"a": math.nan})


def umi(tmp_path, text, name="u.tsv.gz"):
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()))
    return str(path)


def test_umi_reader_returns_cells_as_asked(spark, tmp_path):
    path = umi(tmp_path, "gene\tc1\tc2\tc3\ng1\t1\t0\t2\ng2\t0\t3\t4\n")
    got = {(r.gene, r.ord): (r.cell, r.value, r.n_detected) for r in counts.read_umi_tsv(spark, path, ["c3", "c1"], 2, ["c1", "c2"]).collect()}
    assert got == {("g1", 0): ("c3", 2.0, 1), ("g1", 1): ("c1", 1.0, 1), ("g2", 0): ("c3", 4.0, 1), ("g2", 1): ("c1", 0.0, 1)}


@pytest.mark.parametrize("text", ["gene\tc1\tc2\ng1\t1\n", "gene\tc1\tc2\ng1\t1\t-2\n", "gene\tc1\tc2\ng1\t1\tx\n", "gene\tc1\tc1\ng1\t1\t2\n", "gene\tc1\tc2\n\t1\t2\n", "gene\tc1\tc2\ng1\t1\t2\ng1\t1\t2\n", "gene\tc1\tc2\ng1\t1\t2\n\n", "gene\tc1\tc2\ng1\t1\t1.5\n", "gene\tc1\tc2\ng1\t1\t9007199254740992\n"])
def test_umi_reader_refuses(spark, tmp_path, text):
    with pytest.raises(counts.SourceError):
        counts.read_umi_tsv(spark, umi(tmp_path, text), ["c1"])


MTX = "%%MatrixMarket matrix coordinate integer general\n%\n4 3 4\n1 1 5\n2 2 7\n3 3 9\n3 3 1\n"


def test_mtx_reader(spark, tmp_path):
    out, sizes = counts.read_mtx(spark, umi(tmp_path, MTX, "m.mtx.gz"), [3, 2], 3)
    assert sizes == {"rows": 4, "columns": 3, "entries": 4}
    assert {(r.row, r.col, r.value) for r in out.collect()} == {(2, 2, 7.0), (3, 3, 10.0)}


@pytest.mark.parametrize("old, new", [("1 1 5", "5 1 5"), ("4 3 4", "4 3 5"), ("integer", "real"), ("2 2 7", "2 2 -7"), ("2 2 7", "2 2"), ("%%Matrix", "%Matrix")])
def test_mtx_reader_refuses(spark, tmp_path, old, new):
    with pytest.raises(counts.SourceError):
        counts.read_mtx(spark, umi(tmp_path, MTX.replace(old, new), "m.mtx.gz"))[0].collect()


def test_strict_json(tmp_path):
    path = str(tmp_path / "r.json")
    results.write_json(path, {"a": 1.5})
    assert results.read_json(path) == {"a": 1.5}
    with pytest.raises(ValueError):
        results.write_json(path, {"a": math.nan})
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}'):
        (tmp_path / "r.json").write_text(text)
        with pytest.raises(results.ResultError):
            results.read_json(path)


def test_cache_misses_on_any_change(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 0.1)], "a int, b double")

    cache = results.Cache(spark, str(tmp_path), "kappa")
    for _ in range(2):
        assert cache.get(make, "inputs", k=15).count() == 1
    assert len(made) == 1
    cache.get(make, "other", k=15)
    cache.get(make, "inputs", k=16)
    assert len(made) == 3
    note = next(p for p in (tmp_path / "kappa").iterdir() if p.suffix == ".json")
    note.write_text(json.dumps({}))
    for k in (15, 16):
        cache.get(make, "inputs", k=k)
    cache.get(make, "other", k=15)
    assert len(made) == 4


def test_publication(tmp_path):
    pub = results.Publication(str(tmp_path))
    assert pub.accepted() is None
    attempt = pub.attempt()
    results.write_json(f"{attempt}/r.json", {"a": 1})
    pub.accept(attempt, ["r.json"])
    assert pub.accepted() == attempt

    def lost(path, value):
        raise OSError("gone")

    with pytest.raises(results.ResultError, match="uncertain"):
        pub.accept(attempt, ["r.json"], lost)
    results.write_json(f"{attempt}/r.json", {"a": 2})
    with pytest.raises(results.ResultError, match="changed"):
        pub.accepted()


def dense(spark, seed=1, cells=12, genes=30):
    """A sparse table and its matrix, a gene and a cell without counts included."""
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.6, (cells, genes)).astype(float) * rng.uniform(0.5, 2, genes)
    x[:, 3], x[5] = 0, 0
    rows = [(i, j, float(x[i, j])) for i in range(cells) for j in range(genes) if x[i, j]]
    return x, spark.createDataFrame(rows, "cell long, gene long, value double"), spark.range(cells).withColumnRenamed("id", "cell")


@pytest.mark.parametrize("ddof", [0, 1])
def test_scaling_against_the_dense_matrix(spark, ddof):
    x, values, cells = dense(spark)
    has = [j for j in range(x.shape[1]) if x[:, j].any()]
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=ddof) > 0, x.std(axis=0, ddof=ddof), 1), -1.5, 1.5)
    got = {(r.cell, r.gene): r.value for r in normalize.scaled(values, 1.5, ddof, cells).collect()}
    assert got.keys() == {(i, j) for i in range(len(x)) for j in has}
    assert all(got[i, j] == pytest.approx(z[i, j], abs=1e-9) for i, j in got)


@pytest.mark.parametrize("window", [3, 4, 7, 100])
def test_copy_number_against_the_dense_matrix(spark, window):
    x, values, _ = dense(spark)
    x = np.delete(x, 5, axis=0)  # has no row in the table
    cells = [c for c in range(12) if c != 5]
    has = [j for j in range(30) if x[:, j].any()]
    genes = spark.createDataFrame([(j, "pq"[j % 2], 100 - j) for j in range(30)], "gene long, arm string, start long")
    got = {(r.cell, r.arm): r.score for r in normalize.arm_scores(values, genes, spark.createDataFrame([(0,), (2,), (4,)], "cell long"), window, 0.8).collect()}
    base = x[[cells.index(c) for c in (0, 2, 4)]].mean(axis=0)
    for arm in "pq":
        mine = [j for j in sorted(has, reverse=True) if "pq"[j % 2] == arm]
        centred = np.clip(x[:, mine] - base[mine], -0.8, 0.8)
        n, w = len(mine), min(window, len(mine))
        late = w % 2
        outputs = [[min(max(j, 1), n) - 1 for j in range(i + late - (w - 1) // 2, i + late + w // 2 + 1)] for i in range(1, n + 1 - late)]
        score = np.mean([centred[:, o].mean(axis=1) for o in outputs], axis=0)
        assert [got[c, arm] for c in cells] == pytest.approx(score.tolist(), abs=1e-9)


def test_axes_must_have_the_same_names_once(spark):
    one = spark.createDataFrame([("a", 0), ("b", 1)], "k string, at long")
    assert {tuple(r) for r in labels.permutation(one, spark.createDataFrame([("b", 5), ("a", 6)], "k string, at long"), "k", "at").collect()} == {("a", 0, 6), ("b", 1, 5)}
    for other in ([("a", 0)], [("a", 0), ("b", 1), ("c", 2)], [("a", 0), ("b", 1), ("b", 2)]):
        for pair in ((one, spark.createDataFrame(other, "k string, at long")), (spark.createDataFrame(other, "k string, at long"), one)):
            with pytest.raises(Exception, match="same names"):
                labels.permutation(*pair, "k", "at").collect()


def test_lookups_are_strict_about_repeated_and_missing_keys(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    once, twice = spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, v long")
    assert {tuple(r) for r in labels.lookup(df, once, "k", "v", 0).collect()} == {("a", 1), ("z", 0), (None, 0)}
    with pytest.raises(Exception, match="not in the table"):
        labels.lookup(df, once, "k", "v", strict=True).collect()
    with pytest.raises(Exception, match="more than once"):
        labels.lookup(df, twice, "k", "v", 0).collect()


@pytest.mark.parametrize("deltas, verdict", [([0.4] * 9 + [-0.1], "stable"), ([0.4] * 8 + [-0.1] * 2, "partly fragile"), ([0.2] * 10, "partly fragile"), ([0.05] * 10, "fragile"), ([0.4] * 4 + [-0.4] * 6, "fragile"), ([-0.5] * 10, "fragile")])
def test_stability(spark, deltas, verdict):
    assert meta.stability(spark.createDataFrame([(d,) for d in deltas], "delta double")).first().verdict == verdict


@pytest.mark.parametrize("four, verdict", [((0.5, -0.1, 0.0, 0.0), "KILLED"), ((0.5, 0.25, 0.3, 0.3), "WEAKENED"), ((0.5, 0.4, -0.3, 0.3), "NULL-MATCHED"), ((0.5, 0.4, 0.1, 0.3), "DEPTH-CONFOUNDED"), ((0.5, 0.4, 0.1, -0.3), "SURVIVES"), ((0.0, 0.0, 0.1, 0.1), "SURVIVES")])
def test_batch_verdicts(spark, four, verdict):
    rows = list(zip(("original", "corrected", "random", "depth"), four)) + [("random", four[2] + 0.01), ("random", four[2] - 0.01)]
    assert meta.batch_verdict(spark.createDataFrame(rows, "method string, delta double")).first().verdict == verdict


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_neighbours_in_blocks_are_those_of_one_join(spark, monkeypatch, spread):
    """Equal to the last bit, ties and repeated points included; most pairs of blocks are not compared where points cluster."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(900, 5)) + spread * rng.integers(0, 6, (900, 1))
    points[600:700] = np.round(points[600:700])
    points[700:720] = points[0]
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>")
    few = table.where("id < 3")
    one, three = ({tuple(r) for r in graph.neighbours(t, "id", "x", 4).collect()} for t in (table, few))
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "BLOCK", 60)
    assert {tuple(r) for r in graph.neighbours(table, "id", "x", 4).collect()} == one
    assert {tuple(r) for r in graph.neighbours(few, "id", "x", 4).collect()} == three


def test_both_fits_give_the_same_model(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5))
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.8
    rows = spark.createDataFrame([(i, bool(y[i]), x[i].tolist()) for i in range(300)], "id long, y boolean, x array<double>")
    train, test = rows.where("id < 200"), rows.where("id >= 200")
    here = {r.id: r.score for r in ml.logistic_scores(train, test, "y", "x").collect()}
    monkeypatch.setattr(ml, "LOCAL", 0)
    newton = {r.id: r.score for r in ml.logistic_scores(train, test, "y", "x").collect()}
    assert here.keys() == newton.keys() and all(here[i] == pytest.approx(newton[i], abs=1e-9) for i in here)
    monkeypatch.setattr(ml, "NEWTON", 0)
    plain = {r.id: r.score for r in ml.logistic_scores(train, test, "y", "x").collect()}
    assert newton.keys() == plain.keys() and all(newton[i] == pytest.approx(plain[i], abs=1e-4) for i in newton)
    # at the optimum the gradient of the penalised, balanced loss vanishes
    z = (x[:200] - x[:200].mean(0)) / x[:200].std(0)
    w = np.where(y[:200], 100 / y[:200].sum(), 100 / (~y[:200]).sum())
    table = spark.createDataFrame([(float(b), a.tolist(), float(c)) for a, b, c in zip(z, y, w)], "label double, features array<double>, w double")
    beta = ml.logistic_weights(table, 1.0, 5)
    p = 1 / (1 + np.exp(-(z @ beta[:-1] + beta[-1])))
    assert np.abs(z.T @ (w * (p - y[:200])) + beta[:-1]).max() < 1e-6 and abs((w * (p - y[:200])).sum()) < 1e-6


def test_runs_made_together_are_those_made_alone(spark, monkeypatch):
    """Every seed's scores, on the driver and by passes; and the jobs do not grow with the seeds."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    y = x[:, 0] + rng.normal(size=90) > 0.4
    df = spark.createDataFrame([(i, bool(y[i]), x[i].tolist()) for i in range(90)] + [(90, None, [0.0, 0.0, 0.0])], "id long, y boolean, x array<double>").repartition(3)
    alone = {}
    for seed in (1, 2):
        split = ml.stratified_split(df, "y", "id", 0.2, seed)
        alone |= {(seed, i): r.score for i, r in enumerate(ml.logistic_scores(split.where("not test"), split.where("test"), "y", "x").orderBy("score").collect())}
    for local in (ml.LOCAL, 0):
        monkeypatch.setattr(ml, "LOCAL", local)
        scored = ml._runs_scored(df, "y", "id", "x", 2, 0.2, 3)
        got = {(seed, i): r.score for seed in (1, 2) for i, r in enumerate(scored.where(f"run = {seed}").orderBy("score").collect())}
        assert got.keys() == alone.keys() and all(abs(got[k] - alone[k]) < 1e-9 for k in got)
    monkeypatch.undo()
    jobs = []
    for seeds in (1, 4):
        spark.sparkContext.setJobGroup(f"seeds-{seeds}", "")
        assert ml.repeated_auc(df, "y", "id", "x", seeds).first().n == seeds
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"seeds-{seeds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3
    assert ml.repeated_auc(df.limit(0), "y", "id", "x", 3).first().n == 0
