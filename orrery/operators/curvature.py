"""Edge curvature: Ollivier-Ricci by exact transport over graph distances, and Bakry-Émery by local eigenproblems.

Edges or vertices are dealt over the executors. A graph of up to MAX_EDGES edges is broadcast; the distances, or the
neighbourhoods, of a larger one are found by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned

#: Edges of a graph that is broadcast; numbers that one search from all nodes holds.
MAX_EDGES, SEARCHED = 5_000_000, 1 << 22
# Tolerances of the local eigenproblem, what an infeasible curvature is given as, and the dimensions it is taken at.
RANGE_TOL, NEGATIVE, KERNEL, PINV, INFEASIBLE = 1e-10, -1e-7, 1e-9, 1e-10, -1e6
DIMENSIONS = (2.0, 3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 20.0, 50.0, 100.0, math.inf)


class CurvatureError(ValueError):
    """A graph or transport problem that has no valid curvature."""


class Graph:
    """Neighbours and weights of each node, in flat arrays."""

    def __init__(self, u: np.ndarray, v: np.ndarray, weight: np.ndarray):
        if len(u) and not (np.isfinite(weight).all() and (weight > 0).all()):
            raise CurvatureError("edge weights must be positive and finite")
        ends, others = np.concatenate([u, v]), np.concatenate([v, u])
        self.ids, at = np.unique(ends, return_inverse=True)
        to = np.searchsorted(self.ids, others)
        order = np.lexsort((to, at))
        self.start = np.searchsorted(at[order], np.arange(len(self.ids) + 1))
        self.to, self.weight = to[order], np.concatenate([weight, weight])[order]
        self.place = np.full(len(self.ids), -1)  # of nodes among those that a search meets; -1 between searches

    def index(self, node: int) -> int:
        return int(np.searchsorted(self.ids, node))

    def neighbours(self, i: int) -> np.ndarray:
        return self.to[self.start[i] : self.start[i + 1]]

    def reached(self, sources: np.ndarray, limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each source the nodes within its limit, and their distances.

        All sources are searched at once: a step takes the edges of every node that the step before has brought nearer.
        """
        n = len(self.ids)
        best = np.full(len(sources) * n, np.inf)
        front = np.arange(len(sources)) * n + sources
        best[front] = 0.0
        while len(front):
            row, node = np.divmod(front, n)
            degree = self.start[node + 1] - self.start[node]
            edge = np.repeat(self.start[node] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
            total = np.repeat(best[front], degree) + self.weight[edge]
            place = np.repeat(row * n, degree) + self.to[edge]
            nearer = (total < best[place]) & (total <= np.repeat(limits[row], degree))
            place = place[nearer]
            np.minimum.at(best, place, total[nearer])
            front = np.unique(place)
        rows = best.reshape(len(sources), n)
        found = [np.flatnonzero(np.isfinite(r)) for r in rows]
        return [(f, r[f]) for f, r in zip(found, rows)]

    def stepped(self, key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (row * nodes + node) and lengths after each edge of each key's node."""
        row, node = np.divmod(key, len(self.ids))
        degree = self.start[node + 1] - self.start[node]
        edge = np.repeat(self.start[node] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
        return np.repeat(row * len(self.ids), degree) + self.to[edge], np.repeat(length, degree) + self.weight[edge]

    def balls(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, ascending, and distances of the nodes within its radius of each centre. Only what is within costs anything."""
        key = front = np.arange(len(centres)) * len(self.ids) + centres
        d = near = np.zeros(len(centres))
        while len(front):
            tried, total = self.stepped(front, near)
            within = total <= radii[tried // len(self.ids)]
            tried, total = tried[within], total[within]
            order = np.lexsort((total, tried))
            tried, total = tried[order], total[order]
            first = np.diff(tried, prepend=-1) > 0
            tried, total = tried[first], total[first]
            at = np.minimum(np.searchsorted(key, tried), len(key) - 1)
            new = key[at] != tried
            nearer = ~new & (total < d[at])
            d[at[nearer]] = total[nearer]
            front, near = tried[new | nearer], total[new | nearer]
            key, d = np.concatenate([key, tried[new]]), np.concatenate([d, total[new]])
            order = np.argsort(key, kind="stable")
            key, d = key[order], d[order]
        return key, d

    def distances(self, sources: np.ndarray, targets: np.ndarray, from_sources: np.ndarray, from_targets: np.ndarray) -> np.ndarray:
        """Shortest path lengths from sources to targets, known not to be beyond the sum of the radii around both: a shortest path
        leaves the ball of its source over one edge, and the end of that edge lies in the ball of its target."""
        n = len(self.ids)
        (a, da), (b, db) = self.balls(sources, from_sources), self.balls(targets, from_targets)
        met = np.unique(b % n)
        place = self.place
        place[met] = np.arange(len(met))
        row, node = np.divmod(a, n)
        degree = self.start[node + 1] - self.start[node]
        edge = np.repeat(self.start[node] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
        to, column = place[self.to[edge]], place[b % n]
        here = np.flatnonzero(to >= 0)  # most edges lead elsewhere
        by = np.repeat(np.arange(len(a)), degree)[here]
        one = np.full(len(sources) * len(met), np.inf)
        own = place[node]
        np.minimum.at(one, row[own >= 0] * len(met) + own[own >= 0], da[own >= 0])
        np.minimum.at(one, row[by] * len(met) + to[here], da[by] + self.weight[edge[here]])
        place[met] = -1
        one = one.reshape(len(sources), len(met))
        ends = np.searchsorted(b, np.arange(len(targets) + 1) * n)
        out = np.empty((len(sources), len(targets)))
        for j in range(len(targets)):
            some = slice(ends[j], ends[j + 1])
            out[:, j] = (one[:, column[some]] + db[some]).min(axis=1)
        if not np.isfinite(out).all():
            raise CurvatureError("support points are not connected")
        return out


def augmented_flow(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Flow and reduced costs by shortest augmenting paths with node prices: slower than a tree's, and never at a standstill."""
    n, m = cost.shape
    flow, left, need = np.zeros((n, m)), supply.astype(float).copy(), demand.astype(float).copy()
    pu, pv = np.zeros(n), cost.min(axis=0) if n else np.zeros(m)
    for _ in range(50 * (n + m) ** 2 + 10):
        if left.max(initial=0) <= tol or need.max(initial=0) <= tol:
            break
        du, dv = np.where(left > tol, 0.0, np.inf), np.full(m, np.inf)
        by_u, by_v = np.full(n, -1), np.full(m, -1)
        done_u, done_v = np.zeros(n, bool), np.zeros(m, bool)
        while True:  # Dijkstra over reduced costs, back along flow at no cost
            cu, cv = np.where(done_u, np.inf, du), np.where(done_v, np.inf, dv)
            i, j = int(cu.argmin()) if n else 0, int(cv.argmin())
            if cu[i] <= cv[j]:
                if not np.isfinite(cu[i]):
                    raise CurvatureError("no way to move the mass")
                done_u[i] = True
                step = du[i] + np.maximum(0.0, cost[i] + pu[i] - pv)
                nearer = (step < dv) & ~done_v
                dv[nearer], by_v[nearer] = step[nearer], i
            else:
                done_v[j] = True
                if need[j] > tol:
                    end = j
                    break
                back = (flow[:, j] > tol) & ~done_u & (dv[j] < du)
                du[back], by_u[back] = dv[j], j
        limit = dv[end]
        pu += np.minimum(du, limit)
        pv += np.minimum(dv, limit)
        path, j = [], end
        while True:
            i = int(by_v[j])
            path.append((i, j, 1))
            if by_u[i] < 0:
                break
            j = int(by_u[i])
            path.append((i, j, -1))
        amount = min(left[i], need[end], *(flow[a, b] for a, b, s in path if s < 0))
        for a, b, s in path:
            flow[a, b] += s * amount
        left[i] -= amount
        need[end] -= amount
    return flow, cost + pu[:, None] - pv[None]


def tree_flow(supply: list[float], demand: list[float], cost: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Flow and reduced costs by the transport simplex: the cells in use form a tree over rows and columns, and the cell that
    saves most per unit enters it, until none does. A step costs what it cuts off, not the tree. None if that takes more than steps (ties can make it stand still)."""
    n, m = cost.shape
    left, need = list(supply), list(demand)
    around: list[dict[int, float]] = [{} for _ in range(n + m)]  # rows, then columns: neighbours in the tree and flow
    rows, columns = [True] * n, [True] * m
    open_rows, open_columns = n, m
    for cell in np.argsort(cost, axis=None, kind="stable").tolist():  # a cheap start: each cell closes a row or a column
        i, j = divmod(cell, m)
        if not (rows[i] and columns[j]):
            continue
        x = min(left[i], need[j])
        around[i][n + j] = around[n + j][i] = x
        left[i] -= x
        need[j] -= x
        if open_rows == open_columns == 1:
            break
        if open_columns == 1 or (open_rows > 1 and left[i] <= need[j]):
            rows[i], open_rows = False, open_rows - 1
        else:
            columns[j], open_columns = False, open_columns - 1
    enough = -1e-12 * max(1.0, float(np.abs(cost).max()))
    listed, price, parent, depth = cost.tolist(), [0.0] * (n + m), [-1] * (n + m), [0] * (n + m)
    root, reduced = max(range(n + m), key=lambda k: len(around[k])), None
    for _ in range(steps):
        if reduced is None:
            stack = [root]
            while stack:
                node = stack.pop()
                for other in around[node]:
                    if other != parent[node]:
                        parent[other], depth[other] = node, depth[node] + 1
                        price[other] = (listed[node][other - n] if node < n else listed[other][node - n]) - price[node]
                        stack.append(other)
            reduced, fresh = cost - np.array(price[:n])[:, None] - np.array(price[n:])[None], True
        at = int(reduced.argmin())
        i, j = divmod(at, m)
        saved = float(reduced[i, j])
        if saved >= enough:
            if not fresh:  # the changes have been added up: once more from the tree
                parent[root], reduced = -1, None
                continue
            flow = np.zeros((n, m))
            for row in range(n):
                for column, x in around[row].items():
                    flow[row, column - n] = x
            return flow, reduced
        one, two = [i], [n + j]
        while one[-1] != two[-1]:
            side = one if depth[one[-1]] >= depth[two[-1]] else two
            side.append(parent[side[-1]])
        path = one + two[-2::-1]  # from the row to the column, along the tree
        pairs = list(zip(path, path[1:]))
        least, out = min((around[x][y], k) for k, (x, y) in enumerate(pairs) if k % 2 == 0)
        for k, (x, y) in enumerate(pairs):
            around[x][y] = around[y][x] = around[x][y] + (-least if k % 2 == 0 else least)
        x, y = pairs[out]
        del around[x][y], around[y][x]
        around[i][n + j] = around[n + j][i] = least
        # what is cut off hangs from the new cell; its prices alone change, its rows' by one amount and its columns' by the opposite
        top, above = (i, n + j) if out < len(one) - 1 else (n + j, i)
        parent[top], depth[top] = above, depth[above] + 1
        below = [top]
        for node in below:
            for other in around[node]:
                if other != parent[node]:
                    parent[other], depth[other] = node, depth[node] + 1
                    below.append(other)
        change = saved if top < n else -saved
        low, high = [k for k in below if k < n], [k - n for k in below if k >= n]
        if low:
            reduced[low] -= change
        if high:
            reduced[:, high] += change
        fresh = False
    return None


def transport_cost(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving supply to demand, proven by reduced costs that are not negative."""
    if abs(supply.sum() - demand.sum()) > 1e-9 * max(1.0, supply.sum()) or (supply < 0).any() or (demand < 0).any():
        raise CurvatureError("masses must be equal and not negative")
    if not cost.size:
        return 0.0
    if not np.isfinite(cost).all():
        raise CurvatureError("no way to move the mass")
    flow, reduced = tree_flow(supply.tolist(), demand.tolist(), cost, 20 * sum(cost.shape)) or augmented_flow(supply, demand, cost)
    slack = 1e-9 * max(1.0, supply.sum())
    if np.abs(flow.sum(1) - supply).max(initial=0) > slack or np.abs(flow.sum(0) - demand).max(initial=0) > slack or flow.min() < -slack or reduced.min() < -1e-9 * max(1.0, float(np.abs(cost).max())) or abs((flow * reduced).sum()) > 1e-9 * max(1.0, float(np.abs(cost).max())) * max(1.0, supply.sum()):
        raise CurvatureError("transport did not reach a proven optimum")
    return float((flow * cost).sum())


def spread(end: int, around: list[int], alpha: float) -> dict[int, float]:
    """Mass of a lazy walk's next step: alpha stays, the rest goes evenly to the neighbours."""
    out = {end: alpha}
    for k in around:
        out[k] = out.get(k, 0.0) + (1 - alpha) / len(around)
    return out


def moved(one: dict[int, float], two: dict[int, float]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Nodes that have mass to give and to take, and how much: what both spreads have at a node stays."""
    rest = {k: one.get(k, 0.0) - two.get(k, 0.0) for k in sorted(one.keys() | two.keys())}
    give, take = [k for k, x in rest.items() if x > 1e-15], [k for k, x in rest.items() if x < -1e-15]
    supply, demand = np.array([rest[k] for k in give]), np.array([-rest[k] for k in take])
    return give, take, supply, demand * (supply.sum() / demand.sum()) if take else demand


def ollivier(graph: Graph, u: int, v: int, alpha: float = 0.5) -> tuple[float, float]:
    """Curvature of edge (u, v) and the graph distance of its ends.

    Each end spreads alpha on itself and the rest evenly over its neighbours; curvature is 1 less the cost of moving one
    spread onto the other, in units of the ends' distance. Not clipped.
    """
    if not 0 <= alpha <= 1:
        raise CurvatureError("alpha must lie in [0, 1]")
    i, j = graph.index(u), graph.index(v)
    around = [graph.neighbours(end) for end in (i, j)]
    give, take, supply, demand = moved(*(spread(end, x.tolist(), alpha) for end, x in zip((i, j), around)))
    # no way is longer than the one over the edge itself
    edge = float(graph.weight[graph.start[i] : graph.start[i + 1]][around[0] == j].min(initial=np.inf))
    if not math.isfinite(edge):
        raise CurvatureError("there is no such edge")
    reach = {int(k): float(w) for end in (i, j) for k, w in zip(graph.neighbours(end), graph.weight[graph.start[end] : graph.start[end + 1]])}
    # a way over the edge is as long as both ends' halves of it, so that these are radii to search within
    starts, stops = sorted({i, *give}), sorted({j, *take})
    radii = (np.array([(reach.get(k, 0.0) + edge / 2) * (1 + 1e-12) for k in some]) for some in (starts, stops))
    length = graph.distances(np.array(starts), np.array(stops), *radii)
    d = float(length[starts.index(i), stops.index(j)])
    if not give or not take:
        return 1.0, d
    cost = length[np.searchsorted(starts, give)][:, np.searchsorted(stops, take)] / d
    return 1.0 - transport_cost(supply, demand, cost), d


def ollivier_restricted(edges: list[tuple[int, int, float]], u: int, v: int, alpha: float = 0.5) -> float:
    """The older definition, kept as a counter-example: distances within the supports' own subgraph, in units of the edge's weight."""
    weight = {frozenset(e[:2]): e[2] for e in edges}
    around = {x: {o for e in weight for o in e if x in e and o != x} for x in (u, v)}
    support = {u, v} | around[u] | around[v]
    inner = [(*sorted(e), w) for e, w in weight.items() if e <= support]
    graph = Graph(*(np.array(c) for c in zip(*inner)))
    kappa, d = ollivier(graph, u, v, alpha)
    return 1 - (1 - kappa) * d / weight[frozenset((u, v))]


def _collected(edges: DataFrame) -> Graph | None:
    """The graph, if it is small enough to be broadcast."""
    if edges.count() > MAX_EDGES:
        return None
    t = edges.select("u", "v", F.col("weight").cast("double").alias("weight")).toArrow()
    return Graph(*(t[c].to_numpy() for c in ("u", "v", "weight")))


def _both_ways(edges: DataFrame) -> DataFrame:
    """node, other, weight in either direction."""
    good = F.when(F.col("weight").cast("double") > 0, F.col("weight").cast("double")).otherwise(F.raise_error(F.lit("edge weights must be positive and finite")).cast("double"))
    checked = edges.select("u", "v", good.alias("weight"))
    return checked.select(F.col("u").alias("node"), F.col("v").alias("other"), "weight").unionByName(checked.select(F.col("v").alias("node"), F.col("u").alias("other"), "weight"))


def distances_by_joins(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, d: nodes within the limit of each source (source, limit), by rounds of joins that bring nodes nearer."""
    step = pinned(_both_ways(edges), "steps")
    limits = pinned(sources.groupBy("source").agg(F.max("limit").alias("limit")), "limits")
    found = front = pinned(limits.select("source", F.col("source").alias("node"), F.lit(0.0).alias("d")), "reached")
    while not front.isEmpty():
        tried = front.join(step, "node").select("source", F.col("other").alias("node"), (F.col("d") + F.col("weight")).alias("d"))
        tried = tried.join(limits, "source").where(F.col("d") <= F.col("limit")).groupBy("source", "node").agg(F.min("d").alias("d"))
        known = found.select("source", "node", F.col("d").alias("was"))
        front = pinned(tried.join(known, ["source", "node"], "left").where(F.col("was").isNull() | (F.col("d") < F.col("was"))).select("source", "node", "d"), "front")
        found = pinned(found.unionByName(front).groupBy("source", "node").agg(F.min("d").alias("d")), "reached")
    return found


def all_pairs(edges: DataFrame) -> DataFrame:
    """source, node, d: the distances of all nodes to all that they reach, themselves included. The result has as many rows as there are such pairs."""
    spark = edges.sparkSession
    ends = edges.select(F.col("u").alias("source")).unionByName(edges.select(F.col("v").alias("source"))).distinct()
    whole = _collected(edges)
    if whole is None:
        return distances_by_joins(edges, ends.withColumn("limit", F.lit(math.inf)))
    shared = spark.sparkContext.broadcast(whole)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        size = max(1, SEARCHED // max(1, len(graph.ids)))
        for batch in batches:
            sources = batch.column(0).to_numpy()
            at = np.searchsorted(graph.ids, sources)
            for i in range(0, len(at), size):
                for source, (nodes, lengths) in zip(sources[i : i + size], graph.reached(at[i : i + size], np.full(len(at[i : i + size]), np.inf))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), source)), pa.array(graph.ids[nodes]), pa.array(lengths)], names=["source", "node", "d"])

    return ends.select(F.col("source").cast("long")).repartition(spark.sparkContext.defaultParallelism).mapInArrow(found, "source long, node long, d double")


def _ollivier_by_joins(edges: DataFrame, wanted: DataFrame, alpha: float) -> DataFrame:
    """ollivier_edges of a graph that is too large to be broadcast: each edge to measure gets the part of the graph that its distances
    are searched in, by rounds of joins within the radii around its supports (Graph.distances), and is measured there."""
    step = pinned(_both_ways(edges), "steps")
    asked = pinned(wanted.select("u", "v", F.col("weight").cast("double").alias("weight")), "wanted")
    ends = asked.select("u", "v", "weight", F.explode(F.array("u", "v")).alias("node"))
    own = ends.select("u", "v", "node", (1.5 * F.col("weight")).alias("left"))
    around = ends.join(step.select("node", "other", F.col("weight").alias("way")), "node").select("u", "v", F.col("other").alias("node"), (F.col("way") + F.col("weight") / 2).alias("left"))
    # what is left of the largest radius at each node
    found = front = pinned(own.unionByName(around).groupBy("u", "v", "node").agg((F.max("left") * (1 + 1e-9)).alias("left")), "reached")
    while not front.isEmpty():
        tried = front.join(step, "node").select("u", "v", F.col("other").alias("node"), (F.col("left") - F.col("weight")).alias("left")).where("left >= 0").groupBy("u", "v", "node").agg(F.max("left").alias("left"))
        known = found.withColumnRenamed("left", "was")
        front = pinned(tried.join(known, ["u", "v", "node"], "left").where("was is null or left > was").select("u", "v", "node", "left"), "front")
        found = pinned(found.unionByName(front).groupBy("u", "v", "node").agg(F.max("left").alias("left")), "reached")
    inside = found.select("u", "v", "node")
    near = inside.join(step.where("node < other"), "node").join(inside.withColumnRenamed("node", "other"), ["u", "v", "other"])
    ready = asked.join(near.groupBy("u", "v").agg(F.collect_list(F.struct("node", "other", F.col("weight").alias("w"))).alias("near")), ["u", "v"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                near = batch.column(3)[at].values
                part = Graph(*(near.field(c).to_numpy() for c in ("node", "other", "w")))
                found.append(ollivier(part, batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), alpha))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.float64()), batch.column(2), pa.array([f[1] for f in found], pa.float64())], names=["u", "v", "kappa", "d_uv", "d_graph_uv"])

    return ready.select("u", "v", "weight", "near").mapInArrow(measured, CURVATURES)


CURVATURES = "u long, v long, kappa double, d_uv double, d_graph_uv double"


def ollivier_edges(edges: DataFrame, measure: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """u, v, kappa, d_uv, d_graph_uv for the edges to measure (all by default) of a graph (u, v, weight)."""
    if not 0 <= alpha <= 1:
        raise CurvatureError("alpha must lie in [0, 1]")
    spark = edges.sparkSession
    wanted = edges.select("u", "v", "weight") if measure is None else edges.join(measure.select("u", "v"), ["u", "v"], "left_semi").select("u", "v", "weight")
    whole = _collected(edges)
    if whole is None:
        return _ollivier_by_joins(edges, wanted, alpha)
    shared = spark.sparkContext.broadcast(whole)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [ollivier(graph, a, b, alpha) for a, b in zip(u, v)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.float64()), batch.column(2).cast(pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["u", "v", "kappa", "d_uv", "d_graph_uv"])

    # an edge costs what is around it, a hub's many times another's: dealt by hash into several tasks a core, none is the last by much
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-wanted.count() // 2000))
    return wanted.repartition(parts, F.xxhash64("u", "v")).sortWithinPartitions("u", "v").mapInArrow(measured, CURVATURES)


def gamma_forms(graph: Graph, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forms of Gamma and Gamma_2 and the Laplacian at a node, over the nodes at most two steps away; the node comes first."""
    near = graph.neighbours(i).tolist()
    far = sorted({int(k) for a in near for k in graph.neighbours(a)} - {i, *near})
    nodes = [i, *near, *far]
    at = {x: k for k, x in enumerate(nodes)}
    n, k = len(nodes), len(near)
    step = np.zeros((k + 1, n))  # where a walk from the node, or a neighbour of it, goes next
    for row, x in enumerate([i, *near]):
        around = graph.neighbours(x).tolist()
        step[row, [at[y] for y in around]] = 1 / len(around)

    def gamma(row: int) -> np.ndarray:
        e = np.eye(n)[row]
        return 0.5 * (np.diag(step[row]) - np.outer(step[row], e) - np.outer(e, step[row]) + np.outer(e, e))

    laplace = step - np.eye(k + 1, n)
    own = gamma(0)
    spread = sum((gamma(r) for r in range(1, k + 1)), np.zeros((n, n))) / k - own
    moved = np.zeros((n, n))
    for r in range(1, k + 1):
        part = np.outer(np.eye(n)[r] - np.eye(n)[0], laplace[r] - laplace[0])
        moved += (part + part.T) / 2
    return own, 0.5 * (spread - moved / k), laplace[0]


def bakry_emery(graph: Graph, node: int, dimensions: tuple[float, ...] = DIMENSIONS) -> list[float]:
    """The largest K with Gamma_2(f) >= K Gamma(f) + (Lf)^2 / N at a node, for each N; INFEASIBLE if there is none.

    The form is reduced onto where Gamma does not vanish (a Schur complement), and its least eigenvalue against Gamma taken.
    """
    gamma, gamma2, laplace = gamma_forms(graph, graph.index(node))
    n, m = len(gamma), len(graph.neighbours(graph.index(node))) + 1  # Gamma reads the node and its neighbours, which come first
    values, axes = np.linalg.eigh(gamma[:m, :m])
    on = values > RANGE_TOL * max(1.0, values.max())
    if not on.any():
        return [math.nan] * len(dimensions)
    seen, hidden = np.zeros((n, on.sum())), np.zeros((n, n - on.sum()))
    seen[:m] = axes[:, on] / np.sqrt(values[on])
    hidden[:m, : m - on.sum()], hidden[m:, m - on.sum() :] = axes[:, ~on], np.eye(n - m)
    # where Gamma vanishes the Laplacian does too, so only what is left over depends on the dimension
    block, cross = hidden.T @ gamma2 @ hidden, seen.T @ gamma2 @ hidden
    level, turn = np.linalg.eigh((block + block.T) / 2)
    kernel, turned = level < KERNEL, cross @ turn
    # cross is in units of Gamma; the test is in the coordinates' own
    if level.min(initial=0) < NEGATIVE or (kernel.any() and np.linalg.norm(turned[:, kernel] * np.sqrt(values[on])[:, None]) > -NEGATIVE):
        return [INFEASIBLE] * len(dimensions)
    inverse = np.divide(1, level, out=np.zeros_like(level), where=np.abs(level) > PINV * np.abs(level).max(initial=0))
    reduced, drift = seen.T @ gamma2 @ seen - (turned * inverse) @ turned.T, seen.T @ laplace
    forms = (reduced - np.outer(drift, drift) / dimension for dimension in dimensions)
    return [float(np.linalg.eigvalsh((form + form.T) / 2).min()) for form in forms]


def effective_dimension(curvatures: list[float], dimensions: tuple[float, ...] = DIMENSIONS) -> float:
    """The dimension at which half of the curvature gained from the least dimension to infinity is reached, linear in 1 / N;
    2 if next to nothing is gained, NaN if a curvature is not finite.

    Curvature cannot rise with 1 / N, so its curve can be read the other way round: 1 / N as a function of curvature.
    """
    if not np.isfinite(curvatures).all():
        return math.nan
    inverse = 1 / np.array(dimensions)
    by = np.argsort(inverse)
    lost = np.maximum.accumulate(curvatures[by[0]] - np.array(curvatures)[by])  # of what infinity has
    if lost[-1] < 1e-4:
        return 2.0
    at = float(np.interp(lost[-1] / 2, lost, inverse[by]))
    return 1 / at if at > 0 else math.inf


def _curved(graph: Graph, ids: list[int], dimensions: tuple[float, ...]) -> pa.RecordBatch:
    found = [bakry_emery(graph, i, dimensions) for i in ids]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array([effective_dimension(f, dimensions) for f in found], pa.float64())], names=["id", "curvature", "effective_dimension"])


def bakry_emery_nodes(edges: DataFrame, nodes: DataFrame, dimensions: tuple[float, ...] = DIMENSIONS) -> DataFrame:
    """id, curvature (array by dimension), effective_dimension for each node (id) with an edge; weights are not used.

    A node needs its neighbours' neighbours only: these are joined to it, and no task holds the graph.
    """
    around = _both_ways(edges.withColumn("weight", F.lit(1.0))).groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("around"))
    own = nodes.select(F.col("id").cast("long").alias("id")).join(around.withColumnRenamed("node", "id"), "id")
    near = own.select("id", F.explode("around").alias("node")).join(around, "node").groupBy("id").agg(F.collect_list(F.struct("node", "around")).alias("near"))
    ready = own.join(near, "id").select("id", "around", "near")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = {(min(x["node"], k), max(x["node"], k)) for x in row["near"] for k in x["around"]}
                u, v = (np.array(c, np.int64) for c in zip(*pairs))
                yield _curved(Graph(u, v, np.ones(len(u))), [row["id"]], dimensions)

    return ready.mapInArrow(measured, "id long, curvature array<double>, effective_dimension double")
