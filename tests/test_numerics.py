import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import tails
from orrery.operators import cluster, curvature, delaunay, ward


def graph(edges):
    return curvature.Graph(*(np.array(c) for c in zip(*[(a, b, float(w)) for a, b, w in edges])))


def cycle(n):
    return [(min(i, (i + 1) % n), max(i, (i + 1) % n), 1.0) for i in range(n)]


@pytest.mark.parametrize("edges, kappa", [([(0, 1, 2.5)], 1.0), (cycle(3), 0.75), (cycle(4), 0.5), (cycle(5), 0.25)])
def test_ollivier_on_known_graphs(edges, kappa):
    for u, v, _ in edges:
        assert curvature.ollivier(graph(edges), u, v)[0] == pytest.approx(kappa, abs=1e-12)


def test_the_older_definition_differs_on_the_five_cycle():
    assert curvature.ollivier_restricted(cycle(5), 0, 1) == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("alpha, kappa", [(0, 0.5), (0.5, 0.75), (1, 0)])
def test_laziness_on_a_triangle_of_weight_two(alpha, kappa):
    assert curvature.ollivier(graph([(0, 1, 2.0), (1, 2, 2.0), (0, 2, 2.0)]), 0, 1, alpha)[0] == pytest.approx(kappa, abs=1e-12)


@pytest.mark.parametrize("weight", [0.0, -1.0, math.nan])
def test_weights_must_be_positive(weight):
    with pytest.raises(curvature.CurvatureError):
        graph([(0, 1, weight)])


def test_scale_does_not_matter_and_kappa_stays_below_one():
    x = np.random.default_rng(7).normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    edges = sorted({(min(i, int(j)), max(i, int(j))) for i in range(40) for j in np.argsort(d[i])[1:6]})
    base = [curvature.ollivier(graph([(u, v, d[u, v]) for u, v in edges]), u, v)[0] for u, v in edges]
    assert max(base) <= 1 + 1e-12
    for scale in (3e-6, 2e5):
        again = [curvature.ollivier(graph([(u, v, scale * d[u, v]) for u, v in edges]), u, v)[0] for u, v in edges]
        assert again == pytest.approx(base, abs=1e-9)


def test_transport_against_all_assignments():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(20):
        cost = rng.random((5, 5))
        best = min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5))) / 5
        assert curvature.transport_cost(np.full(5, 0.2), np.full(5, 0.2), cost) == pytest.approx(best, abs=1e-12)


def test_bakry_emery_of_a_square():
    found = curvature.bakry_emery(graph(cycle(4)), 0)
    assert found[-1] == pytest.approx(1, abs=1e-9) and found == sorted(found)
    assert curvature.effective_dimension(found) == pytest.approx(4, abs=1e-6)
    assert curvature.effective_dimension([0.5] * len(curvature.DIMENSIONS)) == 2
    assert math.isnan(curvature.effective_dimension([math.nan] * len(curvature.DIMENSIONS)))


def test_tails():
    assert tails.norm_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert tails.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-10)
    assert tails.t_sf(-2.2281388519649385, 10) == pytest.approx(0.975, rel=1e-10)
    assert tails.norm_logsf(40) == pytest.approx(-804.608442, rel=1e-8)
    assert tails.chi2_logsf(1000, 3) == pytest.approx(-496.770920, rel=1e-8)
    assert tails.mann_whitney_p(20, 4, 5, 0) == pytest.approx(2 / 126)


def test_ward_splits_two_blobs_and_louvain_two_triangles():
    x = np.vstack([np.random.default_rng(0).normal(0, 0.1, (15, 2)), np.random.default_rng(1).normal(3, 0.1, (12, 2))])
    assert ward.cut(ward.ward(x), 27, 2).tolist() == [0] * 15 + [1] * 12
    triangles = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    assert cluster.louvain([(u, v, 1.0) for u, v in triangles]) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_delaunay_has_an_empty_circle_for_each_edge_count():
    n = len(cluster.delaunay(np.random.default_rng(3).random((50, 2))))
    assert 50 - 1 <= n <= 3 * 50 - 6
    assert len(cluster.delaunay(np.array([[0, 0], [1, 0], [0, 1], [1, 1.1]]))) == 5


def test_half_saturation_between_grid_points():
    """Curvature 1 - 2 / N: half of the gain from 2 to infinity at N = 4; with a bend, between 5 and 10."""
    grid = curvature.DIMENSIONS
    assert 7.0 in grid and 100.0 in grid
    assert curvature.effective_dimension([1 - 2 / n for n in grid]) == pytest.approx(4)
    bent = [0.0 if n < 7 else 0.25 if n == 7 else 1.0 for n in grid]
    # linear in 1 / N between 7 (0.25) and 10 (1)
    assert curvature.effective_dimension(bent) == pytest.approx(1 / (1 / 10 + (1 / 7 - 1 / 10) * (0.5 / 0.75)))


@pytest.mark.parametrize("n1, n2", [(1, 1), (3, 4), (4, 3), (2, 7), (8, 8)])
def test_exact_mann_whitney_against_all_orders(n1, n2):
    import itertools

    found = {}
    for places in itertools.combinations(range(n1 + n2), n1):
        u = sum(p - i for i, p in enumerate(places))
        found[u] = found.get(u, 0) + 1
    total = sum(found.values())
    for u in range(n1 * n2 + 2):
        assert tails.mann_whitney_exact_sf(u, n1, n2) == pytest.approx(sum(c for v, c in found.items() if v >= u) / total, abs=1e-14)


def test_exact_mann_whitney_of_a_large_and_a_small_arm():
    began = time.time()
    both = [tails.mann_whitney_p(8 * 50_000 * 0.9, *n, 0) for n in ((50_000, 8), (8, 50_000))]
    assert both[0] == both[1] and time.time() - began < 10
    # beside 50,000 values, those of the small arm lie like uniform ones, whose sum is beyond 7.2 of 8 this often
    assert both[0] == pytest.approx(2 * 0.8**8 / math.factorial(8), rel=0.01)


def random_graph(seed, n=40, more=60):
    rng = np.random.default_rng(seed)
    found = {(i, i + 1): float(rng.uniform(0.5, 2)) for i in range(n - 1)}
    for a, b in rng.integers(0, n, (more, 2)).tolist():
        if a != b:
            found[min(a, b), max(a, b)] = float(rng.uniform(0.5, 4))
    return [(10 * a, 10 * b, w) for (a, b), w in sorted(found.items())]


def floyd(edges):
    ids = sorted({x for e in edges for x in e[:2]})
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0)
    for u, v, w in edges:
        i, j = ids.index(u), ids.index(v)
        d[i, j] = d[j, i] = min(w, d[i, j])
    for k in range(len(ids)):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return ids, d


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_distances_and_curvature_of_small_and_large_graphs(spark, monkeypatch, most):
    """The same by a broadcast graph and by joins, and as by all paths."""
    edges = random_graph(5)
    ids, d = floyd(edges)
    monkeypatch.setattr(curvature, "MAX_EDGES", most)
    table = spark.createDataFrame(edges, "u long, v long, weight double")
    got = {(r.source, r.node): r.d for r in curvature.all_pairs(table).collect()}
    assert got.keys() == {(a, b) for a in ids for b in ids} and all(got[a, b] == pytest.approx(d[ids.index(a), ids.index(b)]) for a, b in got)
    some = table.where("u % 20 = 0")
    rows = {(r.u, r.v): r for r in curvature.ollivier_edges(table, some).collect()}
    plain = graph(edges)
    assert rows.keys() == {e[:2] for e in edges if e[0] % 20 == 0}
    for (u, v), r in rows.items():
        masses = []
        for end in (u, v):
            around = [b if a == end else a for a, b, _ in edges if end in (a, b)]
            masses.append({x: (x == end) * 0.5 + (x in around) * 0.5 / len(around) for x in {end, *around}})
        a, b = (sorted(m) for m in masses)
        cost = np.array([[d[ids.index(x), ids.index(y)] for y in b] for x in a]) / d[ids.index(u), ids.index(v)]
        kappa = 1 - curvature.transport_cost(np.array([masses[0][x] for x in a]), np.array([masses[1][y] for y in b]), cost)
        assert r.kappa == pytest.approx(kappa, abs=1e-9) and r.kappa == pytest.approx(curvature.ollivier(plain, u, v)[0], abs=1e-12) and r.d_graph_uv == pytest.approx(d[ids.index(u), ids.index(v)])


def test_bakry_emery_nodes_against_the_whole_graph(spark):
    edges = random_graph(6)
    table = spark.createDataFrame(edges, "u long, v long, weight double")
    whole = graph(edges)
    nodes = spark.createDataFrame([(x,) for x in [*whole.ids.tolist(), 7]], "id long")
    got = {r.id: r for r in curvature.bakry_emery_nodes(table, nodes).collect()}
    assert got.keys() == set(whole.ids.tolist())
    for i, r in got.items():
        assert r.curvature == pytest.approx(curvature.bakry_emery(whole, i), abs=1e-9)


def test_transport_by_tree_and_by_paths():
    """Random masses, equal masses with ties in every cost, and masses of zero."""
    rng = np.random.default_rng(11)
    for k in range(300):
        n, m = rng.integers(1, 9, 2)
        cost = rng.integers(0, 4, (n, m)).astype(float) if k % 2 else rng.uniform(0, 5, (n, m))
        supply = np.full(n, 1 / n) if k % 3 else rng.dirichlet(np.ones(n))
        demand = np.full(m, 1 / m) if k % 3 else rng.dirichlet(np.ones(m))
        if k % 5 == 0 and n > 1:
            supply[0] = 0
            supply /= supply.sum()
        flow, _ = curvature.augmented_flow(supply, demand, cost)
        assert curvature.transport_cost(supply, demand, cost) == pytest.approx(float((flow * cost).sum()), abs=1e-9)


def test_an_edge_costs_what_is_around_it_not_the_graph():
    """A grid of 250,000 nodes: nothing as long as its nodes is made for an edge."""
    import tracemalloc

    side = 500
    at = np.arange(side * side).reshape(side, side)
    u, v = (np.concatenate([x.ravel(), y.ravel()]) for x, y in ((at[:, :-1], at[:-1]), (at[:, 1:], at[1:])))
    whole = curvature.Graph(u, v, np.random.default_rng(3).uniform(0.5, 1.5, len(u)))
    middle = int(at[250, 250])
    tracemalloc.start()
    kappa, d = curvature.ollivier(whole, middle, middle + 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20 and math.isfinite(kappa) and d <= 1.5
    near = at[244:257, 244:258].ravel()
    part = np.isin(u, near) & np.isin(v, near)
    weight = {(a, b): w for a, b, w in zip(*(np.repeat(np.arange(side * side), np.diff(whole.start)), whole.to, whole.weight))}
    assert curvature.ollivier(curvature.Graph(u[part], v[part], np.array([weight[e] for e in zip(u[part], v[part])])), middle, middle + 1) == pytest.approx((kappa, d), abs=1e-12)


def test_triangles_are_exact_where_points_lie_on_lines_and_circles():
    """A grid: all edges of its squares and one diagonal of each, the same whatever other points are there."""
    p = np.array([(x, y) for x in range(6) for y in range(6)], float)
    ids = np.random.default_rng(1).permutation(36)
    t = delaunay.triangles(p, ids)
    real = t[t[:, 2] >= 0]
    assert len(real) == 50 and len(t) == 70 and (delaunay.orientation(p[real[:, 0]], p[real[:, 1]], p[real[:, 2]]) == 1).all()
    some = np.flatnonzero((p < 4).all(axis=1))
    part = {frozenset(ids[some][list(r)].tolist()) for r in delaunay.triangles(p[some], ids[some]).tolist() if min(r) >= 0}
    assert part <= {frozenset(ids[list(r)].tolist()) for r in real.tolist()}


def test_a_hubs_edges_are_dealt_over_tasks_and_wide_transports_agree(spark):
    """All edges of one hub lay in one task when they were dealt by ranges of an end."""
    star = [(0, i, 1.0 + i / 1000) for i in range(1, 201)] + [(i, i + 1, 1.0) for i in range(1, 200)]
    edges = spark.createDataFrame(star, "u long, v long, weight double")
    hub = edges.where("u = 0").select("u", "v")
    parts = [r["count"] for r in curvature.ollivier_edges(edges, hub).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 200 and max(parts) <= 60
    rng = np.random.default_rng(5)
    for n, m in ((3, 120), (90, 4), (40, 40), (1, 30)):
        supply, demand, cost = rng.random(n), rng.random(m), np.round(rng.random((n, m)) * 3, 1)
        demand *= supply.sum() / demand.sum()
        flow, reduced = curvature.tree_flow(supply.tolist(), demand.tolist(), cost, 20 * (n + m))
        other, _ = curvature.augmented_flow(supply, demand, cost)
        assert abs((flow * cost).sum() - (other * cost).sum()) < 1e-9 and reduced.min() > -1e-9
        assert np.allclose(flow.sum(1), supply) and np.allclose(flow.sum(0), demand)
