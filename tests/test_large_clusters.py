"""What the driver does for small tables, done for tables of any size: the same results, or no worse ones."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import batches, cluster, communities, delaunay, diffusion, eigen, models, normalize, ward
from orrery.plans import composites


def quality(edges, home):
    """Modularity by its definition, edge by edge."""
    total = 2 * sum(w for *_, w in edges)
    inside, mass = defaultdict(float), defaultdict(float)
    for u, v, w in edges:
        mass[home[u]] += w
        mass[home[v]] += w
        inside[home[u]] += 2 * w * (home[u] == home[v])
    return sum(inside[c] / total - (mass[c] / total) ** 2 for c in mass)


def planted(groups, size, near, far, seed):
    rng, n = np.random.default_rng(seed), groups * size
    return [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if rng.random() < (near if i // size == j // size else far)]


def grown(n, seed):
    rng, edges, ends = np.random.default_rng(seed), [(0, 1, 1.0)], [0, 1]
    for i in range(2, n):
        for j in {ends[rng.integers(len(ends))] for _ in range(3)}:
            edges.append((j, i, 1.0 + j % 2))
            ends += [i, j]
    return edges


def neighbours(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 5))
    x[: n // 2, 0] += 3
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    return [(i, j, 1.0) for i, j in sorted({(min(i, int(j)), max(i, int(j))) for i in range(n) for j in np.argsort(d[i])[1:7]})]


GRAPHS = {
    "planted": planted(8, 12, 0.6, 0.03, 2),
    "ring of cliques": [(6 * c + i, 6 * c + j, 1.0) for c in range(10) for i in range(6) for j in range(i + 1, 6)] + [(6 * c, (6 * c + 7) % 60, 1.0) for c in range(10)],
    "grown": grown(150, 0),
    "neighbours": neighbours(150, 1),
    "weighted": [(u, v, 3.0 if u // 15 == v // 15 else 1.0) for u, v, _ in planted(4, 30, 0.35, 0.04, 5)],
}
GRID = [(10 * i + j, 10 * i + j + 1, 1.0) for i in range(10) for j in range(9)] + [(10 * i + j, 10 * i + j + 10, 1.0) for i in range(9) for j in range(10)]


@pytest.mark.parametrize("name", GRAPHS)
def test_moves_made_at_once_are_no_worse_than_one_after_the_other(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "u long, v long, weight double")
    found = communities.communities(df, weighted=True, small=0)
    home = {r.id: r.community for r in found.collect()}
    in_turn = cluster.louvain(edges)
    assert home.keys() == in_turn.keys() and quality(edges, home) >= quality(edges, in_turn) - 1e-9
    assert communities.modularity(df, found, True) == pytest.approx(quality(edges, home))
    first = [home[n] for n in sorted(home)]
    assert list(dict.fromkeys(first)) == list(range(max(first) + 1))


def test_a_grid_without_communities_comes_close(spark):
    """All of its nodes and moves are alike, so that partitions differ by chance: within two hundredths."""
    home = {r.id: r.community for r in communities.communities(spark.createDataFrame(GRID, "u long, v long, weight double"), small=0).collect()}
    assert quality(GRID, home) >= quality(GRID, cluster.louvain(GRID)) - 0.02


def test_rounds_over_blocks_are_those_of_joins(spark, monkeypatch):
    """The same moves, modularity and merged graph, with hubs, loops and several blocks, in one job of packed blocks a round."""
    monkeypatch.setattr("orrery.operators.eigen.ROWS", 16)
    edges = [(7 * u - 30, 7 * v - 30, w) for u, v, w in [*GRAPHS["grown"], (5, 5, 2.0), (90, 90, 1.0)]]
    both = communities._both_ways(spark.createDataFrame(edges, "u long, v long, w double")).persist()
    total = both.agg(F.sum("w")).first()[0]
    graph = communities._packed(both, total)
    assert graph.table.count() > 8
    state, nodes = graph.alone(), communities._alone(both)
    for turn in range(2):
        one, two = graph.moved(state, turn).persist(), communities._round(both, nodes, total, turn).persist()
        state, nodes = one.select("blk", "ids", F.col("to").alias("com"), "k"), two.select("id", F.col("to").alias("com"), "k", "loop")
        assert {tuple(r) for r in graph.homes(state).collect()} == {(r.id, r.com) for r in nodes.collect()}
        sums = one.agg(F.sum("inside"), F.sum("loops"), F.sum("wants"), F.max("squares")).first()
        masses = two.groupBy("com").agg(F.sum("k").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()
        assert tuple(sums) == pytest.approx((*two.agg(F.sum("inside"), F.sum("loop"), F.count_if("wants")).first(), masses[0]))
    assert {tuple(r) for r in graph.merged(state).collect()} == {tuple(r) for r in communities._merged(both, nodes).collect()}
    again = graph.at(graph.homes(state))
    assert {tuple(r) for r in graph.homes(again).collect()} == {(r.id, r.com) for r in nodes.collect()}


def test_nodes_with_too_many_edges_for_a_block_are_left_to_joins(spark, monkeypatch):
    monkeypatch.setattr(communities, "ENDS", 0)
    df = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (4, 6, 1.0), (5, 6, 1.0)], "u long, v long, weight double")
    assert {r.id: r.community for r in communities.communities(df, small=0).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}


def test_a_merged_graph_is_finished_on_the_driver(spark):
    edges = GRAPHS["planted"]
    found = communities.communities(spark.createDataFrame(edges, "u long, v long, weight double"), small=60)
    assert quality(edges, {r.id: r.community for r in found.collect()}) >= quality(edges, cluster.louvain(edges)) - 1e-9


def test_small_graphs_go_node_by_node_and_odd_edges_count(spark):
    edges = GRID
    df = spark.createDataFrame(edges, "u long, v long, weight double")
    assert {r.id: r.community for r in communities.communities(df).collect()} == cluster.louvain(edges)
    odd = spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0), (2, 3, 1.0), (7, 7, 1.0), (4, None, 1.0), (5, 6, -1.0)], "u long, v long, weight double")
    for small in (0, 100):
        assert {r.id: r.community for r in communities.communities(odd, True, small).collect()} == {1: 0, 2: 0, 3: 0, 7: 1}
        assert communities.communities(odd.limit(0), True, small).collect() == []


def test_batches_are_corrected_as_on_the_driver(spark):
    rng = np.random.default_rng(4)
    group, batch = np.arange(150) % 3, np.arange(150) % 4
    x = rng.normal(size=(150, 4)) * 0.3 + np.eye(4)[group] * 5 + 2 + np.outer(batch, [0, 1.2, 0, 0.4])
    rows = spark.createDataFrame([(7 * i, None if batch[i] == 3 else f"b{batch[i]}", x[i].tolist()) for i in range(150)], "id long, b string, x array<double>").repartition(5)
    for rounds in (1, 3):
        one, other = (np.array([r.features for r in batches.batch_corrected(rows, "id", "b", "x", clusters=5, rounds=rounds, small=s).orderBy("id").collect()]) for s in (1000, 0))
        assert np.abs(one - other).max() < 1e-8 and np.abs(one - x).max() > 0.1


def plain_ward(x):
    """All squared heights kept and updated after each merge of the least: (rows of a, rows of b, height)."""
    parts, out = {i: [i] for i in range(len(x))}, []
    while len(parts) > 1:
        height = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        h, i, j = min((height(parts[i], parts[j]), i, j) for i in parts for j in parts if i < j)
        out.append((frozenset(parts[i]), frozenset(parts[j]), h**0.5))
        parts[i] += parts.pop(j)
    return out


def test_ward_by_means_against_all_heights():
    rng = np.random.default_rng(8)
    for n in (2, 3, 40):
        x = rng.normal(size=(n, 3)) + 100
        rows, got = {i: frozenset([i]) for i in range(n)}, []
        for t, (a, b, h) in enumerate(ward.ward(x)):
            got.append((frozenset([rows[a], rows[b]]), h))
            rows[n + t] = rows[a] | rows[b]
        expected = [(frozenset([a, b]), h) for a, b, h in plain_ward(x)]
        assert {g[0] for g in got} == {e[0] for e in expected} and [g[1] for g in got] == pytest.approx([e[1] for e in expected], rel=1e-9)


def test_twenty_thousand_rows_in_little_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    x = np.random.default_rng(1).normal(size=(6000, 16)) + np.repeat(np.eye(16)[:6] * 30, 1000, axis=0)
    label = ward.cut(ward.ward(x), 6000, 6)
    assert [set(label[i : i + 1000]) for i in range(0, 6000, 1000)] == [{k} for k in range(6)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB; a table of distances has 288,000


def test_a_group_over_many_tasks_has_the_same_clones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) + 4 * rng.integers(0, 3, size=(400, 1)) * np.array([1, 0.5, 0, 0])
    x[7], x[8] = [60, 60, 0, 0], [60, 61.5, 0, 0]  # far from all others: a high merge among the first
    rows = [("big", i, x[i].tolist()) for i in range(330)] + [(None, i, x[i].tolist()) for i in range(330, 390)] + [("one", 1, x[390].tolist())]
    df = spark.createDataFrame(rows, "p string, id long, x array<double>").repartition(3)
    for most, least in ((5, 1), (3, 10)):
        whole = {(r.p, r.id): r.subclone for r in ward.subclones(df, "p", "id", "x", most, least).collect()}
        split = {(r.p, r.id): r.subclone for r in ward.subclones(df, "p", "id", "x", most, least, limit=40, block=64).collect()}
        assert whole == split and len(whole) == len(rows) and whole["one", 1] == 0 and len(set(whole.values())) > 1


def test_rows_that_are_alike_merge_too(spark):
    df = spark.createDataFrame([("g", i, [float(i // 60), 0.0]) for i in range(180)], "p string, id long, x array<double>")
    got = ward.subclones(df, "p", "id", "x", 3, 1, limit=50, block=32).collect()
    assert sorted((r.id, r.subclone) for r in got) == [(i, i // 60) for i in range(180)]


def test_nearest_clusters_are_found_in_passing(spark):
    """Those that ask lie in several tasks, which see all others in many small parts and hold none of these."""
    rng = np.random.default_rng(12)
    x, size = rng.integers(0, 4, size=(300, 3)).astype(float), rng.integers(1, 4, size=300).astype(float)  # with many equal heights
    df = spark.createDataFrame([("a" if i < 290 else None, i, float(size[i]), x[i].tolist()) for i in range(300)], "g string, at long, size double, mean array<double>").repartition(3)
    got = {r.at: (r.g, r.to, r.h) for r in ward._nearest(df.where("at % 3 > 0"), df, 16).collect()}
    assert got.keys() == {i for i in range(300) if i % 3}
    for i, (g, to, h) in got.items():
        among = range(290) if i < 290 else range(290, 300)
        assert (h, to) == min((2 * size[i] * size[j] / (size[i] + size[j]) * ((x[i] - x[j]) ** 2).sum(), j) for j in among if j != i) and g == ("a" if i < 290 else None)
    plan = ward._nearest(df, df, 16)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_leading_eigenvectors_against_the_whole_matrix(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    points = spark.createDataFrame([(5 * i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    edges, root = diffusion.kernel(points, "id", "x", 8)
    whole, at = np.zeros((120, 120)), {5 * i: i for i in range(120)}
    for r in edges.collect():
        whole[at[r.u], at[r.v]] += r.t
    assert np.allclose(whole, whole.T, atol=1e-14)
    e, v = np.linalg.eigh(whole)
    first = np.array([r.root for r in root.orderBy("id").collect()])
    assert e[-1] == pytest.approx(1) and np.allclose(whole @ first, first)
    for block, most in ((6, 200), (3, 30)):  # at once, and with restarts
        values, axes = eigen.leading(lambda x, width: diffusion.times(edges, x, width), root, 1.0, 4, block, most)
        got = np.array([r.axes for r in axes.orderBy("id").collect()])
        assert values == pytest.approx(e[::-1][1:5], abs=1e-9) and np.allclose(got.T @ got, np.eye(4), atol=1e-8)
        assert np.allclose(whole @ got, got * values, atol=1e-7)


def test_pseudotime_over_joins_is_the_driver_s(spark):
    t = np.sort(np.random.default_rng(1).random(150))
    x = np.c_[np.cos(4 * t), np.sin(4 * t), 3 * t] + np.random.default_rng(2).normal(size=(150, 3)) * 0.05
    df = spark.createDataFrame([(3 * i, x[i].tolist()) for i in range(150)], "id long, x array<double>").repartition(3)
    one, two = ({r.id: r.pseudotime for r in diffusion.pseudotime(df, "id", "x", 0, 10, 5, s).collect()} for s in (1000, 0))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-6 and two[0] == 0 and max(two.values()) == 1


def test_components_of_long_counts_are_those_of_the_whole_table(spark):
    rng = np.random.default_rng(4)
    whole = np.where(rng.random((70, 40)) < 0.25, rng.gamma(2.0, 1.0, (70, 40)), 0.0)
    whole[:35, :10] += 1.5
    whole[9], whole[:, 39] = 0.0, 0.0
    whole[9, 3] = 0.5
    rows = [(f"c{i}", f"g{j}", float(whole[i, j])) for i in range(70) for j in range(40) if whole[i, j]]
    got = {r.cell: r.pcs for r in normalize.sparse_components(spark.createDataFrame(rows, "cell string, gene string, value double").repartition(3), 5).collect()}
    centred = whole - whole.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:5].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(5)])
    assert len(got) == 70 and np.array([got[f"c{i}"] for i in range(70)]) == pytest.approx(centred @ axes, abs=1e-6)


def test_components_of_few_counts(spark):
    kind = "cell int, gene int, value double"
    assert normalize.sparse_components(spark.createDataFrame([], kind), 3).collect() == []
    got = normalize.sparse_components(spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (2, 2, None)], kind), 3).collect()
    assert sorted((r.cell, [round(x, 9) for x in r.pcs]) for r in got) == [(1, [-1.0]), (2, [1.0])]


def test_logit_by_passes_is_the_driver_s(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = rng.uniform(size=300) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 0.3 * x[:, 1])))
    df = spark.createDataFrame([(int(b), float(a[0]), float(a[1])) for b, a in zip(y, x)] + [(1, None, 1.0)], "y int, a double, b double").repartition(4)
    one, two = (models.logit(df, "y", ["a", "b"], small=s) for s in (1000, 0))
    assert one["n"] == two["n"] == 300 and one["coef"] == pytest.approx(two["coef"], abs=1e-9)
    assert [one[k] for k in ("log_likelihood", "log_likelihood_null", "llr_p")] == pytest.approx([two[k] for k in ("log_likelihood", "log_likelihood_null", "llr_p")])
    p = 1 / (1 + np.exp(-(one["coef"]["intercept"] + x @ [one["coef"]["a"], one["coef"]["b"]])))
    assert np.abs((y - p) @ np.column_stack([np.ones(300), x])).max() < 1e-7


def test_delaunay_by_tiles_is_that_of_the_whole_table(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random((150, 2)), np.array([(x / 8, y / 8) for x in range(9) for y in range(9)]), 20 + rng.random((40, 2)) * [30, 0.01]])  # scattered, on lines and circles, far away
    rows = [(7 * i + 3, *map(float, v)) for i, v in enumerate(p)]
    df = spark.createDataFrame([*rows, (10_000, *rows[0][1:]), (10_001, None, 1.0)], "id long, x double, y double").repartition(3)
    t = delaunay.triangles(p, np.array([r[0] for r in rows]))
    want = {tuple(sorted((rows[a][0], rows[b][0]))) for r in t.tolist() for a, b in ((r[0], r[1]), (r[1], r[2]), (r[2], r[0])) if min(a, b) >= 0}
    for size in (12, 1000):
        got = delaunay.edges(df.where("id < 10000"), size).collect()
        assert {(r.u, r.v) for r in got} == want and len(got) == len(want)
    far = delaunay.delaunay_graph(df, "id", "x", "y", size=40).collect()
    lengths = {(r.u, r.v): r.weight for r in got}
    assert {(r.u, r.v) for r in far} == {e for e, w in lengths.items() if w <= 1.5 * np.median(list(lengths.values()))}


def test_delaunay_on_a_line(spark):
    df = spark.createDataFrame([(i, float((i * 7) % 11), 2.0 * ((i * 7) % 11)) for i in range(11)], "id long, x double, y double")
    place = {i: (i * 7) % 11 for i in range(11)}
    assert sorted(abs(place[r.u] - place[r.v]) for r in delaunay.edges(df).collect()) == [1] * 10


def test_a_basis_is_given_back_when_the_next_is_written(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = lambda: {f for f in os.listdir(folder) if f.startswith(("basis-", "block-"))}
    before = there() if os.path.isdir(folder) else set()
    edges = spark.range(30).selectExpr("id as u", "id as v", "cast(30 - id as double) as t")
    root = spark.range(30).selectExpr("id", "if(id = 0, 1.0D, 0.0D) as root")
    values, axes = eigen.leading(lambda x, width: diffusion.times(edges, x, width), root, 30.0, 2, 3)
    assert values == pytest.approx([29, 28]) and axes.count() == 30 and len(there() - before) <= 2


def test_near_eigenvalues_take_few_products(spark, monkeypatch):
    """Blocks of seven columns make a basis of 84 in so many products; wide ones fill the space."""
    monkeypatch.setattr(eigen, "STEPS", 12)
    n = 300
    edges = spark.range(1, n).selectExpr("id as u", "id as v", f"1 - 0.6D * id / {n} as t")
    both = edges.unionByName(spark.createDataFrame([(0, 0, 1.5)], edges.schema))
    root = spark.range(n).selectExpr("id", "if(id = 0, 1.0D, 0.0D) as root")
    values, axes = eigen.leading(lambda x, width: diffusion.times(both, x, width), root, 1.5, 5)
    assert values == pytest.approx([1 - 0.6 * i / n for i in range(1, 6)], abs=1e-9) and axes.count() == n


def test_products_of_blocks_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(eigen, "ROWS", 16)
    monkeypatch.setattr(eigen, "ONCE", 20)
    rng = np.random.default_rng(8)
    whole = np.where(rng.random((50, 70)) < 0.2, rng.normal(size=(50, 70)), 0.0)
    whole[:, 0] = 1.0
    entries = spark.createDataFrame([(i, j, float(whole[i, j])) for i in range(50) for j in range(70) if whole[i, j]], "i long, j long, value double")
    columns = eigen.Numbered(spark.range(70))
    x = rng.normal(size=(70, 3))
    packed = columns.packed(spark.createDataFrame([(j, x[j].tolist()) for j in range(70)], "id long, x array<double>"), 3, "x")
    got = {r.id: r.y for r in eigen.Numbered(spark.range(50)).rows(eigen.Sparse(entries, 50, 70).times(packed, 3), 3, "y").collect()}
    assert np.allclose([got[i] for i in range(50)], whole @ x)


@pytest.mark.parametrize("most", [0, 100])
def test_scaled_rows_of_what_is_absent_are_made_from_gaps(spark, monkeypatch, most):
    """A gene's other rows are made from the gaps between its cells, long gaps in pieces, and not joined with what is present."""
    monkeypatch.setattr(normalize, "GAP", 7)
    monkeypatch.setattr(normalize, "MAX_CELLS", most)
    rng = np.random.default_rng(6)
    whole = np.where(rng.random((50, 20)) < 0.1, rng.gamma(2.0, 1.0, (50, 20)), 0.0)
    whole[[0, 49], 0], whole[:, 1], whole[:, 2] = 1.0, 2.0, 0.0
    whole[20, 2] = 3.0
    rows = [(f"c{i:02}", j, float(whole[i, j])) for i in range(50) for j in range(20) if whole[i, j]]
    cells = spark.createDataFrame([(f"c{i:02}",) for i in range(50)], "cell string")
    out = normalize.scaled(spark.createDataFrame(rows, "cell string, gene int, value double"), 2.0, 0, cells, 6)
    sd = whole.std(axis=0)
    wanted = np.clip(np.divide(whole - whole.mean(axis=0), sd, out=np.zeros_like(whole), where=sd > 1e-9), -2, 2)
    got = {(r.cell, r.gene): r.value for r in out.collect()}
    assert len(got) == out.count() == 1000
    assert all(abs(got[f"c{i:02}", j] - wanted[i, j]) < 1e-6 for i in range(50) for j in range(20))
    assert "Join Cross" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_curvatures_are_compared_over_all_edges(spark):
    """A ring whose nodes reach two on: 4,200 edges."""
    rng = np.random.default_rng(7)
    pairs = [sorted((i, (i + step) % 2100)) for i in range(2100) for step in (1, 2)]
    edges = spark.createDataFrame([(u, v, float(w)) for (u, v), w in zip(pairs, rng.uniform(0.5, 1.5, len(pairs)))], "u long, v long, weight double")
    got = composites.forman_against_ollivier(edges).first()
    assert got.n == 4200 and -1 <= got.rho <= 1


@pytest.mark.parametrize("shared", [eigen.SHARED, 0])
def test_components_by_blocks_of_genes_are_those_by_joins(spark, monkeypatch, shared):
    """Repeated pairs are added up either way; the matrix is met where it lies, in several blocks, or joined with the columns."""
    monkeypatch.setattr(eigen, "SHARED", shared)
    monkeypatch.setattr(eigen, "ENTRIES", 50)
    joined, times = [], eigen.Gram.times

    def watched(gram, *args):
        out = times(gram, *args)
        joined.append("Join" in out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(eigen.Gram, "times", watched)
    rng = np.random.default_rng(8)
    whole, rows = np.zeros((60, 30)), []
    for i, j, x in zip(rng.integers(0, 60, 700), rng.integers(0, 30, 700), rng.gamma(2.0, 1.0, 700)):
        whole[i, j] += x
        rows.append((int(i), int(j), float(x)))
    got = {r.cell: r.pcs for r in normalize.sparse_components(spark.createDataFrame(rows, "cell int, gene int, value double"), 3).collect()}
    centred = whole - whole.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert len(got) == 60 and np.array([got[i] for i in range(60)]) == pytest.approx(centred @ axes, abs=1e-6)
    assert bool(joined) == bool(shared) and not any(joined)
