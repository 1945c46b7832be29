"""Ward's clusters of groups of any size.

A cluster is its size and its mean: the height of a merge follows from these, so that no table of distances is kept, and the
chain of nearest neighbours of a group of some thousand rows runs in one task in memory in proportion to them. The clusters of a
larger group first merge in rounds over many tasks: clusters meet all of their group for their nearest neighbours, and all that are each
other's nearest merge at once, which gives the merges of the one-by-one way, as no merge brings a third cluster nearer. Of each
round's merges the highest wait, so that those which a cut undoes are left to the chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .batches import matrix

#: Clusters that one task brings together; clusters that pass at once; clusters that ask in one task, and those compared at once.
MAX_ROWS, BLOCK, ASKING, MET = 20_000, 1024, 1 << 15, 1024


def _heights(mean: np.ndarray, size: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Squared heights of merges of one cluster with others."""
    d = others - mean
    return 2 * size * sizes / (size + sizes) * np.einsum("ij,ij->i", d, d)


def ward(x: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of Ward's linkage in order of height, a and b as cluster numbers: rows first, then merges by time.
    A row is the mean of a cluster of its size. By chains of nearest neighbours; memory is that of x."""
    n = len(x)
    mean = np.array(x, float) - np.mean(x, axis=0) if n else np.zeros((0, 0))
    size, row = np.ones(n) if sizes is None else np.array(sizes, float), np.arange(n)  # the row that stands for a cluster
    norm = np.einsum("ij,ij->i", mean, mean)
    place, live, chain, found = np.arange(n), n, [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(row[0])]
        while True:
            a = place[chain[-1]]
            rough = norm[:live] + norm[a] - 2 * (mean[:live] @ mean[a])
            rough *= 2 * size[:live] * size[a] / (size[:live] + size[a])
            rough[a] = np.inf
            # products lose digits, so that all that come near the least are measured by differences
            near = np.flatnonzero(rough <= rough.min() + 1e-12 * (norm[a] + norm[:live].max()) * size[a] * 4)
            exact = _heights(mean[a], size[a], mean[near], size[near])
            b, h = int(near[exact.argmin()]), float(exact.min())
            if len(chain) > 1:
                c = place[chain[-2]]
                if (before := float(_heights(mean[a], size[a], mean[c : c + 1], size[c : c + 1])[0])) <= h:
                    b, h = int(c), before
                    break
            chain.append(int(row[b]))
        chain = chain[:-2]
        found.append((int(row[a]), int(row[b]), float(np.sqrt(h))))
        total = size[a] + size[b]
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / total
        size[a], norm[a] = total, mean[a] @ mean[a]
        live -= 1  # the last cluster takes the place of the one that is gone
        if b != live:
            mean[b], size[b], norm[b], row[b] = mean[live], size[live], norm[live], row[live]
            place[row[b]] = b
    found.sort(key=lambda f: f[2])
    # cluster numbers by a union of the rows that stand for them
    top, name, out = list(range(n)), list(range(n)), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for t, (a, b, h) in enumerate(found):
        ra, rb = root(a), root(b)
        out.append((name[ra], name[rb], h))
        top[rb], name[ra] = ra, n + t
    return out


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Cluster of each of n rows when the last k - 1 merges are undone, numbered by first row."""
    parts = {i: [i] for i in range(n)}
    for t, (a, b, _) in enumerate(merges[: n - k]):
        small, large = sorted((parts.pop(a), parts.pop(b)), key=len)
        large += small
        parts[n + t] = large
    label = np.zeros(n, int)
    for number, rows in enumerate(sorted(parts.values(), key=min)):
        label[rows] = number
    return label


def _nearest(asking: DataFrame, clusters: DataFrame, block: int) -> DataFrame:
    """g, at, to, h: for each cluster that asks, the one in its group with the lowest merge, the lower number of equals.

    The clusters that ask are dealt into tasks. All clusters of the group pass through each of its tasks once, some thousand at a
    time, so that a task holds those that ask there and no more.
    """
    spark = asking.sparkSession
    asked = asking.groupBy("g").count().collect()  # groups of more than `limit` rows
    total, wanted = sum(r["count"] for r in asked), 2 * spark.sparkContext.defaultParallelism
    parts = [max(-(-r["count"] // ASKING), min(-(-r["count"] // block), -(-r["count"] * wanted // total))) for r in asked]
    first = np.cumsum([0, *parts]).tolist()
    tasks = F.broadcast(spark.createDataFrame([(r.g, p, f) for r, p, f in zip(asked, parts, first)], "gt string, parts int, first int"))
    on = F.col("g").eqNullSafe(F.col("gt"))
    task = F.col("first") + F.pmod(F.xxhash64("at"), F.col("parts"))
    own = asking.join(tasks, on).select(task.cast("int").alias("task"), F.lit(0).alias("turn"), "g", "at", "size", "mean")
    all_of = clusters.join(tasks, on).select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("task"), F.lit(1).alias("turn"), "g", "at", "size", "mean")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        one, group = None, None
        for batch in batches:
            own = batch.column(1).to_numpy() == 0
            parts = batch.column(3).to_numpy(), batch.column(4).to_numpy(), matrix(batch.column(5))
            if own.any():
                held.append(tuple(p[own] for p in parts))
                group = batch.column(2)[0]
            if not own.all() and held:
                one = one or Lowest(*(np.concatenate(p) for p in zip(*held)))
                others = [p[~own] for p in parts]
                for i in range(0, len(others[0]), block):
                    one.meet(*(p[i : i + block] for p in others))
        if one:
            kept = np.flatnonzero(one.to >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * len(kept), pa.string()), pa.array(one.at[kept]), pa.array(one.to[kept]), pa.array(one.height[kept])], names=["g", "at", "to", "h"])

    return own.unionByName(all_of).repartitionById(max(1, first[-1]), "task").sortWithinPartitions("turn").mapInArrow(met, "g string, at long, to long, h double")


class Lowest:
    """The lowest merge of each of some clusters with all that they have met, the lower number of equals; at first with none."""

    def __init__(self, at: np.ndarray, size: np.ndarray, mean: np.ndarray):
        order = np.argsort(size, kind="stable")
        self.at, self.size, self.mean = at[order], size[order], mean[order]
        self.to, self.height = np.full(len(at), -1), np.full(len(at), np.inf)
        ends = [*np.flatnonzero(np.diff(self.size, prepend=-1)).tolist(), len(at)]
        self.spans = [slice(i, min(i + MET, b)) for a, b in zip(ends, ends[1:]) for i in range(a, b, MET)]  # of one size each

    def meet(self, at: np.ndarray, size: np.ndarray, mean: np.ndarray) -> None:
        middle = mean.mean(axis=0)
        other = mean - middle
        norms = np.einsum("ij,ij->i", other, other)
        right = np.column_stack([other, np.ones(len(at)), norms])
        there = np.isin(self.at, at)
        for some in self.spans:
            own, mass = self.mean[some] - middle, self.size[some.start]
            norm = np.einsum("ij,ij->i", own, own)
            rough = np.column_stack([-2 * own, norm, np.ones(len(own))]) @ (right * (2 * mass * size / (mass + size))[:, None]).T
            itself = np.flatnonzero(there[some])
            if len(itself):
                rough[itself] = np.where(self.at[some][itself, None] == at, np.inf, rough[itself])
            # products lose digits, so that all that come near the least are measured by differences
            slack, least = 1e-12 * (norm + norms.max()) * mass * 4, rough.min(axis=1)
            most = np.minimum(least, self.height[some]) + slack
            a = np.flatnonzero((least <= most) & np.isfinite(least))
            x, b = np.nonzero(rough[a] <= most[a, None])
            a = a[x]
            d = mean[b] - self.mean[some][a]
            exact = 2 * mass * size[b] / (mass + size[b]) * np.einsum("ij,ij->i", d, d)
            order = np.lexsort((at[b], exact, a))
            first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
            a, h, to = a[first] + some.start, exact[first], at[b[first]]
            better = (h < self.height[a]) | ((h == self.height[a]) & (to < self.to[a]))
            self.height[a[better]], self.to[a[better]] = h[better], to[better]


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _reduced(rows: DataFrame, most: int, limit: int, block: int) -> DataFrame:
    """g, at (row), home (the row that stands for its cluster), size, mean: groups merged down to about `limit` clusters, `most`
    merges of every round that are highest in their group left out."""
    home = rows.select("g", "at", F.col("at").alias("home"))
    clusters = pinned(rows.select("g", "at", F.lit(1.0).alias("size"), F.col("x").alias("mean")), "clusters")
    known = None
    while True:
        sizes = clusters.groupBy("g").agg(F.count("*").alias("of")).where(F.col("of") > limit)
        large = clusters.join(F.broadcast(sizes.withColumnRenamed("g", "gs")), _same("g", "gs")).drop("gs")  # fewer groups than rows / limit
        asking = large if known is None else large.join(known.select(F.col("g").alias("gk"), F.col("at").alias("ak")), _same("g", "gk") & (F.col("at") == F.col("ak")), "left_anti")
        fresh = _nearest(asking, large, block)
        near = pinned(fresh if known is None else fresh.unionByName(known), "nearest")
        back = near.select(F.col("g").alias("g2"), F.col("at").alias("at2"), F.col("to").alias("to2"))
        pairs = near.join(back, _same("g", "g2") & (F.col("to") == F.col("at2")) & (F.col("to2") == F.col("at"))).where("at < to").select("g", "at", "to", "h")
        waiting = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("h"), "at"))
        merged = pinned(pairs.withColumn("r", waiting).where(F.col("r") > most).select(F.col("g").alias("gm"), F.col("at").alias("a"), "to"), "merged")
        if not merged.limit(1).count():
            break
        into = merged.select("gm", F.col("to").alias("old"), F.col("a").alias("new"))
        on = lambda c: F.col("g").eqNullSafe(F.col("gm")) & (F.col(c) == F.col("old"))
        home = pinned(home.join(into, on("home"), "left").select("g", "at", F.coalesce("new", "home").alias("home")), "home")
        gone = clusters.join(into, on("at"), "left").select("g", F.coalesce("new", "at").alias("at"), "size", F.transform("mean", lambda v: v * F.col("size")).alias("s"))
        summed = gone.groupBy("g", "at").agg(F.sum("size").alias("size"), F.sort_array(F.collect_list(F.struct("size", "s"))).alias("s"))  # two clusters at most
        both = F.when(F.size("s") == 2, F.zip_with(F.col("s")[0]["s"], F.col("s")[1]["s"], lambda a, b: a + b)).otherwise(F.col("s")[0]["s"])
        clusters = pinned(summed.select("g", "at", "size", F.transform(both, lambda v: v / F.col("size")).alias("mean")), "clusters")
        touched = merged.select("gm", F.explode(F.array("a", "to")).alias("t"))
        known = pinned(near.join(touched, _same("g", "gm") & ((F.col("at") == F.col("t"))), "left_anti").join(touched, _same("g", "gm") & (F.col("to") == F.col("t")), "left_anti"), "known")
    return home.join(clusters.select(F.col("g").alias("gc"), F.col("at").alias("c"), "size", "mean"), _same("g", "gc") & (F.col("home") == F.col("c"))).select("g", "at", "home", "size", "mean")


def subclones(cells: DataFrame, group: str, id_col: str, features: str, most: int = 5, least_size: int = 10, limit: int = MAX_ROWS, block: int = BLOCK) -> DataFrame:
    """group, id, subclone: Ward clusters within each group, as many as `most`, fewer until each has least_size rows, two at least,
    numbered by their smallest id.

    A group of one row is one clone, null is a group, ids are unique within a group. Groups of more than `limit` rows merge
    over many tasks first. Means are rounded as sums of doubles are, so that merges of equal height may be made in another order.
    """
    rows = pinned(cells.select(F.col(group).cast("string").alias("g"), F.col(id_col).cast("long").alias("at"), F.col(features).cast("array<double>").alias("x")), "rows")
    most_rows = rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    if most_rows <= limit:
        held, home = rows.select("g", "at", F.lit(1.0).alias("size"), F.col("x").alias("mean")), None
    else:
        reduced = pinned(_reduced(rows, most, limit, block), "reduced")
        home = reduced.select("g", "at", "home")
        held = reduced.where("at = home").select("g", "at", "size", "mean")

    def clustered(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        x, size = matrix(t["mean"].combine_chunks()), t["size"].to_numpy()
        n, label = len(x), np.zeros(len(x), int)
        if n > 1:
            merges = ward(x, size)
            for k in range(min(most, n), 1, -1):
                label = cut(merges, n, k)
                if np.bincount(label, size).min() >= least_size:
                    break
        return pa.table({"g": t["g"], "at": t["at"], "subclone": pa.array(label, pa.int32())})

    found = held.groupBy("g").applyInArrow(clustered, "g string, at long, subclone int")
    if home is not None:
        found = home.join(found.select(F.col("g").alias("gf"), F.col("at").alias("f"), "subclone"), _same("g", "gf") & (F.col("home") == F.col("f"))).select("g", "at", "subclone")
    return found.withColumnRenamed("g", group).withColumnRenamed("at", id_col)
