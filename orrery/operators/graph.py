"""Graphs as edge tables (u < v, weight > 0): nearest neighbours, contact graphs, Forman curvature, node summaries, clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .order import percentiles

#: Components of all points up to which they are broadcast (32 MB); beyond, blocks are compared. Vectors of a block; points that blocks are gathered around, at most;
#: bytes of the vectors of a group of blocks; vectors that are compared at once.
SMALL, BLOCK, CENTRES, GROUP, MET = 1 << 22, 2048, 1024, 1 << 26, 2048


def incident(edges: DataFrame, *values: str) -> DataFrame:
    """node, other and the values of every edge, from both of its ends."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e"), *values).select("e.node", "e.other", *values)


def neighbours(points: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """i, j, d, r: the k nearest other points of each, by Euclidean distance, ties to the lesser id. Exact.

    The points of a small table are broadcast. Those of a large one are gathered in blocks: first each block is compared
    with itself, which bounds the distance of a point's k-th neighbour; then with the blocks that can lie within the bounds
    by the triangle inequality. Distances are summed in the order of the components either way, so they are equal to the
    last bit.
    """
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("x is not null")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    if size.n * (size.dims or 0) <= SMALL:
        pairs = _against_all(rows, k)
    else:
        pairs = _blocked(pinned(rows, "points"), size.n, size.dims, k)
    by = Window.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)


class Nearest:
    """The k nearest of all that some points have met, by exact distance, ties to the lesser id; at first of nothing."""

    def __init__(self, i: np.ndarray, x: np.ndarray, k: int):
        self.i, self.x, self.k, self.own = i, x, k, (x * x).sum(1)
        self.bound = np.full(len(i), np.inf)
        self.a, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, j: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(j), MET):
            self._meet(j[at : at + MET], y[at : at + MET])

    def _meet(self, j: np.ndarray, y: np.ndarray) -> None:
        rough = self.x @ y.T
        rough *= -2
        rough += self.own[:, None]
        rough += (y * y).sum(1)[None]
        itself = np.flatnonzero(np.isin(self.i, j))
        if len(itself):
            rough[itself] = np.where(self.i[itself, None] == j[None], np.inf, rough[itself])
        kth = self.bound * self.bound
        if len(j) > self.k and np.isinf(kth).any():
            kth = np.minimum(kth, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
        # all whose rough distance is not surely beyond, then exact ones
        slack = 1e-9 * (1 + np.where(np.isfinite(kth), np.abs(kth), 0) + self.own)
        a, b = np.nonzero((rough <= (kth + slack)[:, None]) & np.isfinite(rough))
        if not len(a):
            return
        d = np.zeros(len(a))
        for c in range(y.shape[1]):  # in the order of SQL's sum
            step = self.x[a, c] - y[b, c]
            d += step * step
        a, j, d = np.concatenate([self.a, a]), np.concatenate([self.j, j[b]]), np.concatenate([self.d, np.sqrt(d)])
        order = np.lexsort((j, d, a))
        a, j, d = a[order], j[order], d[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        self.a, self.j, self.d = (z[place < self.k] for z in (a, j, d))
        self.bound[a[place == self.k - 1]] = d[place == self.k - 1]

    def pairs(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.i[self.a]), pa.array(self.j), pa.array(self.d)], names=["i", "j", "d"])


def _against_all(rows: DataFrame, k: int) -> DataFrame:
    """i, j, d of each point's k nearest; all points are broadcast."""
    whole = rows.toArrow()
    ids = whole["id"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((ids, np.array(whole["x"].to_pylist(), np.float64).reshape(len(ids), -1)))

    def nearest(batches):
        j, y = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                one = Nearest(some.column(0).to_numpy(), np.array(some.column(1).to_pylist(), np.float64).reshape(some.num_rows, -1), k)
                one.meet(j, y)
                yield one.pairs()

    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(nearest, "i long, j long, d double")


def _bytes(x: np.ndarray) -> bytes:
    """Vectors in half the room where that loses nothing."""
    half = x.astype(np.float32)
    return (half if (half == x).all() else x).tobytes()


def _arrays(ids: pa.Scalar, xs: pa.Scalar, dims: int) -> tuple[np.ndarray, np.ndarray]:
    i, held = np.frombuffer(ids.as_buffer(), np.int64), xs.as_buffer()
    kind = np.float32 if held.size == 4 * len(i) * dims else np.float64
    return i, np.frombuffer(held, kind).reshape(len(i), dims).astype(np.float64)


def _blocked(rows: DataFrame, n: int, dims: int, k: int) -> DataFrame:
    """i, j, d of each point's k nearest.

    Blocks are dealt into groups, whose number does not grow with the points until a group's vectors exceed GROUP bytes. A group is
    sent each block that one of its own may need once, so the table moves as often as there are groups, not once for each of its
    blocks; it meets them one after the other, and its bounds shrink as it does.
    """
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, -(-n // BLOCK))).select("x").collect()
    centres = np.array([r.x for r in first])
    apart = np.sqrt(np.maximum((centres**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * centres @ centres.T, 0))
    shared = spark.sparkContext.broadcast((centres, apart))

    def placed(batches):
        centres = shared.value[0]
        for batch in batches:
            x = np.array(batch.column(1).to_pylist())
            rough = (centres**2).sum(1)[None] - 2 * x @ centres.T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rough.argmin(axis=1).astype(np.int32))], names=["id", "x", "centre"])

    near = pinned(rows.mapInArrow(placed, "id long, x array<double>, centre int"), "placed")
    parts = near.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("bigint").alias("parts"))  # CENTRES rows at most
    dealt = near.join(F.broadcast(parts), "centre").withColumn("block", F.col("centre") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts")))

    def packed(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        """A block with its radius and the bounds of its points, from itself alone."""
        i, x, centre = t["id"].to_numpy(), np.array(t["x"].to_pylist()), t["centre"][0].as_py()
        radius = float(np.sqrt(((x - shared.value[0][centre]) ** 2).sum(1)).max())
        one = Nearest(i, x, k)
        one.meet(i, x)
        return pa.table({"block": pa.array([key[0].as_py()]), "centre": pa.array([centre], pa.int32()), "radius": [radius], "most": [float(one.bound.max())], "ids": pa.array([i.tobytes()], pa.binary()), "xs": pa.array([_bytes(x)], pa.binary())})

    held = pinned(dealt.select("block", "centre", "id", "x").groupBy("block").applyInArrow(packed, "block long, centre int, radius double, most double, ids binary, xs binary"), "blocks")

    def reaching(batches):
        """Centres whose blocks can hold something within a block's bounds."""
        apart = shared.value[1]
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for block, centre, radius, most in zip(*(c.to_pylist() for c in batch.columns)):
                # a block around another centre must have at least this radius
                needed = apart[centre] * (1 - 1e-9) - radius * (1 + 1e-9) - most
                out += [(block, c, float(r)) for c, r in enumerate(needed)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())], names=["block", "centre", "needed"])

    widest = held.groupBy("centre").agg(F.max("radius").alias("widest"))
    asked = held.select("block", "centre", "radius", "most").mapInArrow(reaching, "block long, centre int, needed double")
    asked = asked.join(F.broadcast(widest), "centre").where(F.col("needed") <= F.col("widest") * (1 + 1e-9)).drop("widest")
    other = held.select(F.col("block").alias("block2"), "centre", "radius")
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-n * dims * 8 // GROUP))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    met = asked.join(other, "centre").where((F.col("block") != F.col("block2")) & (F.col("needed") <= F.col("radius") * (1 + 1e-9))).select(group, "block", "block2")
    sent = met.groupBy("group", "block2").agg(F.collect_list("block").alias("asks"))
    own = held.select(group, F.lit(0).alias("turn"), "block", F.lit(None).cast("array<bigint>").alias("asks"), "ids", "xs")
    sent = sent.join(held.select(F.col("block").alias("block2"), "ids", "xs"), "block2").select("group", F.lit(1).alias("turn"), F.col("block2").alias("block"), "asks", "ids", "xs")

    def across(batches):
        now, mine = None, {}
        for batch in batches:
            group, turn, block, asks, ids, xs = batch.columns
            for at in range(batch.num_rows):
                if group[at].as_py() != now:
                    for one in mine.values():
                        yield one.pairs()
                    now, mine = group[at].as_py(), {}
                i, x = _arrays(ids[at], xs[at], dims)
                if turn[at].as_py():
                    for asking in asks[at].as_py():
                        mine[asking].meet(i, x)
                else:
                    mine[block[at].as_py()] = one = Nearest(i, x, k)
                    one.meet(i, x)
        for one in mine.values():
            yield one.pairs()

    return own.unionByName(sent).repartition(groups, "group").sortWithinPartitions("group", "turn").mapInArrow(across, "i long, j long, d double")


def knn_graph(points: DataFrame, id_col: str, vector: str, k: int, coincident: str = "error") -> DataFrame:
    """u, v, weight: joined if either is among the other's k nearest. Points in one place are an error, or edges skipped if
    coincident is "skip"."""
    near = neighbours(points, id_col, vector, k)
    weight = F.when(F.col("d") > 0, F.col("d"))
    if coincident == "error":
        weight = weight.otherwise(F.raise_error(F.lit("coincident points")).cast("double"))
    else:
        near = near.where("d > 0")
    return near.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), weight.alias("d")).groupBy("u", "v").agg(F.min("d").alias("weight"))


def coincident_count(points: DataFrame, vector: str) -> DataFrame:
    """n_bad_coincident: rows that share their place with another."""
    return points.groupBy(vector).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_bad_coincident"))


def mean_neighbour_distance(near: DataFrame) -> DataFrame:
    return near.groupBy("i").agg(F.avg("d").alias("mean_d"))


def forman(edges: DataFrame) -> DataFrame:
    """u, v, weight, forman = 2 w - w * sum over edges e' that share an end of 1 / sqrt(w * w'), node weights 1.

    Summed by node first, so that a hub's edges are not paired: at each end, the sum over its edges less the edge itself.
    """
    root = incident(edges, "weight").groupBy("node").agg(F.sum(1 / F.sqrt("weight")).alias("s"))
    w = F.col("weight")
    one = edges.join(root.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(root.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    return one.select("u", "v", "weight", (2 * w - w * (F.col("su") + F.col("sv") - 2 / F.sqrt(w)) / F.sqrt(w)).alias("forman"))


def node_summary(nodes: DataFrame, edges: DataFrame, measured: DataFrame, value: str = "kappa") -> DataFrame:
    """id, kappa, degree, n_incident_measured, coverage_fraction, status for each node (id).

    kappa is the mean over the node's measured edges. An edge measured twice, in either direction, is an error.
    """
    one = measured.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.first(value).alias("x"), F.count("*").alias("c"))
    one = one.select("u", "v", F.when(F.col("c") == 1, F.col("x")).otherwise(F.raise_error(F.lit("an edge is measured twice")).cast("double")).alias("x"))
    deg = incident(edges).groupBy("node").agg(F.count("*").alias("degree"))
    val = incident(one, "x").groupBy("node").agg(F.avg("x").alias("kappa"), F.count("*").alias("m"))
    joined = nodes.select("id").join(deg, F.col("id") == deg["node"], "left").drop("node").join(val, F.col("id") == val["node"], "left").drop("node")
    m, degree = F.coalesce("m", F.lit(0)), F.coalesce("degree", F.lit(0))
    return joined.select("id", "kappa", degree.alias("degree"), m.alias("n_incident_measured"), F.try_divide(m.cast("double"), degree).alias("coverage_fraction"), F.when(m > 0, "measured").otherwise("not_sampled").alias("status"))


def across_seeds(runs: DataFrame) -> DataFrame:
    """id, kappa, n_runs: mean over the runs that measured a node."""
    return runs.where("kappa is not null").groupBy("id").agg(F.avg("kappa").alias("kappa"), F.count("*").alias("n_runs"))


def observed_over_expected(contacts: DataFrame) -> DataFrame:
    """contacts (chrom, i, j, count; i <= j, count > 0) with expected (median at its distance) and oe."""
    distance = F.col("j") - F.col("i")
    expected = percentiles(contacts.where("count > 0").select("chrom", distance.alias("dist"), "count"), "count", [0.5], ["chrom", "dist"]).select("chrom", "dist", F.get("q", F.lit(0)).alias("expected"))
    return contacts.withColumn("dist", distance).join(expected, ["chrom", "dist"]).withColumn("oe", F.try_divide("count", "expected"))


def contact_graph(contacts: DataFrame, floor: float | None = 1.5, min_distance: int = 2, per_node: int = 3) -> DataFrame:
    """chrom, u, v, oe, obs, weight = 1 / ln(1 + obs): the per_node * (covered bins) contacts of the highest oe on each chromosome."""
    covered = contacts.where("count > 0").select("chrom", F.explode(F.array("i", "j")).alias("bin")).distinct().groupBy("chrom").agg(F.count("*").alias("bins"))
    scored = observed_over_expected(contacts).where((F.col("dist") >= min_distance) & (F.col("count") > 0))
    if floor is not None:
        scored = scored.where(F.col("oe") >= floor)
    by = Window.partitionBy("chrom").orderBy(F.desc("oe"), "i", "j")
    top = scored.withColumn("r", F.row_number().over(by)).join(covered, "chrom").where(F.col("r") <= per_node * F.col("bins"))
    return top.select("chrom", F.col("i").alias("u"), F.col("j").alias("v"), "oe", F.col("count").alias("obs"), (1 / F.log(1.0 + F.col("count"))).alias("weight"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles: wedges are formed at the end of fewer edges, so that a hub forms few."""
    e = edges.select("u", "v").distinct()
    deg = incident(e).groupBy("node").agg(F.count("*").alias("d"))
    ranked = e.join(deg.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    out = ranked.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.join(out.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = wedge.join(e.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"], "left_semi")
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, coefficient."""
    deg = incident(edges.select("u", "v").distinct()).groupBy("node").agg(F.count("*").alias("degree"))
    pairs = F.col("degree") * (F.col("degree") - 1) / F.lit(2.0)
    return deg.join(triangles(edges), "node", "left").select("node", "degree", F.coalesce(F.try_divide(F.coalesce("triangles", F.lit(0)).cast("double"), pairs), F.lit(0.0)).alias("coefficient"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the least id reachable. Labels run along edges and, by their own labels, jump; written to the
    checkpoint folder each round where one is set."""
    spark = edges.sparkSession
    both = incident(edges.select("u", "v").distinct())
    now = nodes.select("id", F.col("id").alias("component"))
    durable = bool(spark.conf.get("spark.checkpoint.dir", None))
    if durable and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    cut = (lambda d: d.checkpoint()) if durable else (lambda d: d.persist())
    while True:
        around = both.join(now.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy(F.col("node").alias("id")).agg(F.min("c").alias("c"))
        met = now.join(around, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("best"))
        jump = now.select(F.col("id").alias("best"), F.col("component").alias("j"))
        after = cut(met.join(jump, "best").select("id", F.col("component").alias("was"), F.least("best", "j").alias("component")))
        if after.where("was <> component").isEmpty():
            return after.select("id", "component")
        now = after.select("id", "component")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, mean_degree, mean_clustering, n_components; nodes without edges have clustering 0."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.select("u", "v").distinct().agg(F.count("*").alias("n_edges"))
    c = clustering(edges).agg(F.sum("coefficient").alias("s"))
    k = components(edges, nodes).agg(F.count_distinct("component").alias("n_components"))
    return n.crossJoin(m).crossJoin(c).crossJoin(k).select("n_nodes", "n_edges", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes")).alias("mean_degree"), F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("n_nodes")).alias("mean_clustering"), "n_components")


def contrast_from(measured: DataFrame, mask: DataFrame, is_a: Column, is_b: Column, minimum: int = 30, overlap: str = "reject") -> DataFrame:
    """id, arm, kappa: a contrast of arms over curvature that has been measured once. Ids in both arms are an error, or go if overlap is "exclude"."""
    both = F.lit(None).cast("string") if overlap == "exclude" else F.raise_error(F.lit("arms overlap")).cast("string")
    arms = mask.select("id", F.when(is_a & is_b, both).when(is_a, "a").when(is_b, "b").alias("arm")).where("arm is not null")
    rows = measured.where("status = 'measured'").select("id", "kappa").join(arms, "id")
    sizes = rows.agg(F.count_if(F.col("arm") == "a").alias("na"), F.count_if(F.col("arm") == "b").alias("nb"))
    return rows.crossJoin(F.broadcast(sizes)).where((F.col("na") >= minimum) & (F.col("nb") >= minimum)).select("id", "arm", "kappa")
