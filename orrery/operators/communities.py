"""Communities of large graphs: Louvain by moves that are made at once.

All nodes weigh their neighbours' communities in the same two joins. Half of those that want to move, by a hash that changes with
the round, do so, and of two lone nodes that want each other only one; so nodes do not swap places for ever. A level ends when
modularity, which each round gives for the moves before, no longer rises, and its best partition is kept. Communities become
nodes, until nothing is left to merge or the graph is small enough for the sequential way; at last the nodes move once more
from where the levels have put them.

The edges lie in blocks of nodes, as bytes. A round sends every task the community and degree of all nodes, 12 bytes each, with
some of the blocks, whose nodes it moves; what comes back is as large. Graphs with more nodes than that allows, or with so many
edges at some nodes that a block is too large, take the same rounds by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned, released
from .cluster import louvain
from .eigen import Numbered, bytes_of, held
from .ranks import BROADCAST_KEYS, matched, running

#: Edges up to which communities are found on the driver; a rise of modularity below RISE is none, and so many rounds without one end a level.
SMALL, RISE, PATIENCE, ROUNDS = 1_000_000, 1e-6, 2, 60
#: Nodes of a graph, and ends of edges in a block of nodes, up to which rounds are made over blocks.
NODES, ENDS = 1 << 24, 1 << 23


def _both_ways(edges: DataFrame) -> DataFrame:
    """u, v, w of each edge from either end, parallel ones added up; a loop counts twice, as any edge does."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _round(edges: DataFrame, nodes: DataFrame, total: float, turn: int) -> DataFrame:
    """nodes (id, com, k, loop) with to, the community after this round, inside, the weight from a node into com, and wants."""
    size = nodes.groupBy("com").agg(F.sum("k").alias("mass"), F.count("*").alias("members"))
    placed = nodes.join(size, "com")  # a hot community is one that Spark splits: its row on the other side is one
    near = edges.where("u <> v").join(placed.select(F.col("id").alias("v"), "com", "mass", "members"), "v").select("u", "com", "mass", "members", "w")
    own = placed.select(F.col("id").alias("u"), "com", "mass", "members", F.lit(0.0).alias("w"))
    links = near.unionByName(own).groupBy("u", "com", "mass", "members").agg(F.sum("w").alias("w"))
    weighed = links.join(placed.select(F.col("id").alias("u"), F.col("com").alias("here"), "k", "loop", F.col("members").alias("around")), "u")
    stays = F.col("com") == F.col("here")
    gain = F.col("w") - F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    best = weighed.groupBy("u", "here", "k", "loop", "around").agg(F.max(F.struct(F.round(gain, 12).alias("gain"), stays.alias("stays"), (-F.col("com")).alias("com"), "members")).alias("b"), F.sum(F.when(stays, F.col("w")).otherwise(0.0)).alias("inside"))
    to = -F.col("b.com")
    lone = (F.col("around") == 1) & (F.col("b.members") == 1)
    goes = F.when(lone, to < F.col("here")).otherwise(F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0)
    return best.select(F.col("u").alias("id"), F.col("here").alias("com"), "k", "loop", F.when(~F.col("b.stays") & goes, to).otherwise(F.col("here")).alias("to"), "inside", (~F.col("b.stays")).alias("wants"))


def _settled(edges: DataFrame, nodes: DataFrame, total: float) -> tuple[DataFrame, float]:
    """The best partition (id, com, k, loop) that rounds of moves find from this one, and its modularity."""
    best, most, idle = nodes, -1.0, 0
    for turn in range(ROUNDS):
        moved = pinned(_round(edges, nodes, total, turn), "moves")
        now = moved.groupBy("com").agg(F.sum("inside").alias("inside"), F.sum("loop").alias("loop"), F.sum("k").alias("mass"), F.count_if("wants").alias("wants")).agg(F.sum(F.col("inside") + F.col("loop")).alias("inside"), F.sum(F.col("mass") * F.col("mass")).alias("squares"), F.sum("wants").alias("wants")).first()
        q = now.inside / total - now.squares / total / total
        if q > most + RISE:
            best, most, idle = moved.select("id", "com", "k", "loop"), q, 0
        else:
            idle += 1
        if not now.wants or idle > PATIENCE:
            break
        nodes = moved.select("id", F.col("to").alias("com"), "k", "loop")
    return best, most


def _merged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, w between communities."""
    at = nodes.select("id", "com")
    one = edges.join(at.withColumnsRenamed({"id": "u", "com": "cu"}), "u").join(at.withColumnsRenamed({"id": "v", "com": "cv"}), "v")
    return one.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))


def _alone(edges: DataFrame) -> DataFrame:
    """Each node of the edges in a community of its own."""
    return edges.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("loop")).select("id", F.col("id").alias("com"), "k", "loop")


def _halves(ids: np.ndarray, turn: int) -> np.ndarray:
    """Whether pmod(xxhash64(id, turn), 2) is 0, as Spark has it for a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        first = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        first = mixed(turned(first, 27) * p1 + p4)
        return mixed(turned((first + p5 + np.uint64(4)) ^ (np.uint64(turn) * p1), 23) * p2 + p3) % np.uint64(2) == 0


class Blocks:
    """A graph (u, v, w from both ends) whose nodes are numbered in the order of their ids: a row has a block of nodes and their edges."""

    def __init__(self, edges: DataFrame, numbered: Numbered, total: float):
        self.numbered, self.n, self.size, self.total = numbered, numbered.n, numbered.size, total
        self.groups = edges.sparkSession.sparkContext.defaultParallelism
        i, j = (numbered.table.select(F.col("id").alias(c), F.col("at").alias(a)) for c, a in (("u", "i"), ("v", "j")))
        self.placed = pinned(edges.join(i, "u").join(j, "v").select(F.floor(F.col("i") / self.size).cast("long").alias("blk"), F.col("u").alias("id"), "i", "j", "w"), "ends")
        self.largest = self.placed.groupBy("blk").count().agg(F.max("count")).first()[0]

    def pack(self) -> None:
        def block(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
            t = t.sort_by([("i", "ascending"), ("j", "ascending")])
            i, j, w = (t[c].to_numpy() for c in "ijw")
            first = np.flatnonzero(np.diff(i, prepend=-1))
            parts = {"ids": t["id"].to_numpy()[first], "first": first, "j": j.astype(np.int32), "w": w, "k": np.add.reduceat(w, first), "loops": np.array([w[i == j].sum()])}
            return pa.table({"blk": pa.array([key[0].as_py()], pa.int64())} | {c: bytes_of([a]) for c, a in parts.items()})

        self.table = pinned(self.placed.groupBy("blk").applyInArrow(block, "blk long, ids binary, first binary, j binary, w binary, k binary, loops binary"), "blocks")

    def alone(self) -> DataFrame:
        """blk, ids, com, k: each node in a community of its own. A community goes by the number of a node."""
        size = self.size

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coms = [blk * size + np.arange(len(held(k)), dtype=np.int32) for blk, k in zip(batch.column(0).to_pylist(), batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bytes_of([c.astype(np.int32) for c in coms]), batch.column(2)], names=["blk", "ids", "com", "k"])

        return self.table.select("blk", "ids", "k").mapInArrow(numbers, "blk long, ids binary, com binary, k binary")

    def at(self, homes: DataFrame) -> DataFrame:
        """blk, ids, com, k of a partition (id, com; each community by the id of a node)."""

        def block(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
            return pa.table({"blk": pa.array([key[0].as_py()], pa.int64()), "com": bytes_of([t.sort_by("at")["c"].to_numpy().astype(np.int32)])})

        table = self.numbered.table
        placed = homes.join(table, "id").join(table.select(F.col("id").alias("com"), F.col("at").alias("c")), "com")
        packed = placed.select(F.floor(F.col("at") / self.size).cast("long").alias("blk"), "at", "c").groupBy("blk").applyInArrow(block, "blk long, com binary")
        return self.table.select("blk", "ids", "k").join(packed, "blk").select("blk", "ids", "com", "k")

    def homes(self, state: DataFrame) -> DataFrame:
        """id, com: the partition as rows."""

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, com in zip(*batch.columns):
                    yield pa.RecordBatch.from_arrays([pa.array(held(ids, kind=np.int64)), pa.array(held(com, kind=np.int32).astype(np.int64))], names=["id", "at"])

        rows = state.select("ids", "com").mapInArrow(opened, "id long, at long")
        return rows.join(self.numbered.table.select(F.col("id").alias("com"), "at"), "at").select("id", "com")

    def _each(self, state: DataFrame, made: Callable, kind: str) -> DataFrame:
        """What made(blk, ids, first, j, w, loops, com, k) gives for each block; com and k are those of all nodes."""
        n, size, shown = self.n, self.size, ["ids", "first", "j", "w", "loops"]
        empty = F.lit(None).cast("binary")
        own = self.table.select(F.pmod("blk", F.lit(self.groups)).cast("int").alias("group"), F.lit(1).alias("turn"), "blk", *shown, empty.alias("com"), empty.alias("k"))
        sent = state.select(F.explode(F.lit(list(range(self.groups)))).alias("group"), F.lit(0).alias("turn"), "blk", *(empty.alias(c) for c in shown), "com", "k")

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            com, k = np.zeros(n, np.int32), np.zeros(n)
            for batch in batches:
                for _, turn, blk, ids, first, j, w, loops, c, degree in zip(*batch.columns):
                    blk = blk.as_py()
                    if turn.as_py():
                        yield made(blk, held(ids, kind=np.int64), held(first, kind=np.int64), held(j, kind=np.int32), held(w), held(loops), com, k)
                    else:
                        span = slice(blk * size, min(n, (blk + 1) * size))
                        com[span], k[span] = held(c, kind=np.int32), held(degree)

        return own.unionByName(sent).repartitionById(self.groups, "group").sortWithinPartitions("turn", "blk").mapInArrow(across, kind)

    def moved(self, state: DataFrame, turn: int) -> DataFrame:
        """state with `to`, the communities after this round, and of each block inside, loops, wants; squares are of all masses."""
        n, size, total, sums = self.n, self.size, self.total, []

        def made(blk, ids, first, j, w, loops, com, k):
            if not sums:
                sums.extend((np.bincount(com, k, n), np.bincount(com, minlength=n)))
            (mass, members), low, m = sums, blk * size, len(ids)
            here, own = com[low : low + m], k[low : low + m]
            i = np.repeat(np.arange(m), np.diff(np.append(first, len(j))))
            other = j != low + i
            key = np.concatenate([i[other] * n + com[j[other]], np.arange(m) * n + here])
            order = np.argsort(key, kind="stable")
            key, weight = key[order], np.concatenate([w[other], np.zeros(m)])[order]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            links, node, c = np.add.reduceat(weight, start), key[start] // n, key[start] % n
            stays = c == here[node]
            gain = np.round(links - own[node] * (mass[c] - np.where(stays, own[node], 0.0)) / total, 12)
            best = np.maximum.reduceat(gain, np.flatnonzero(np.diff(node, prepend=-1)))
            top = np.flatnonzero(gain == best[node])
            to = c[top[np.flatnonzero(np.diff(node[top], prepend=-1))]]  # the least of equals, unless it is among them that the node stays
            wants = np.ones(m, bool)
            wants[node[top[stays[top]]]] = False
            lone = (members[here] == 1) & (members[to] == 1)
            goes = wants & np.where(lone, to < here, _halves(ids, turn))
            values = [bytes_of([a]) for a in (ids, here, own, np.where(goes, to, here).astype(np.int32))]
            counts = [pa.array([float(links[stays].sum())]), pa.array([float(loops[0])]), pa.array([int(wants.sum())]), pa.array([float(mass @ mass)])]
            return pa.RecordBatch.from_arrays([pa.array([blk], pa.int64()), *values, *counts], names=["blk", "ids", "com", "k", "to", "inside", "loops", "wants", "squares"])

        return self._each(state, made, "blk long, ids binary, com binary, k binary, to binary, inside double, loops double, wants long, squares double")

    def settled(self, state: DataFrame) -> tuple[DataFrame, float]:
        """What _settled gives, over blocks."""
        best, most, idle, old = state, -1.0, 0, []
        for turn in range(ROUNDS):
            moved = pinned(self.moved(state, turn), "moves")
            now = moved.agg(F.sum(F.col("inside") + F.col("loops")).alias("inside"), F.max("squares").alias("squares"), F.sum("wants").alias("wants")).first()
            q = now.inside / self.total - now.squares / self.total / self.total
            if q > most + RISE:
                best, most, idle = moved.select("blk", "ids", "com", "k"), q, 0
                for table in old:
                    released(table)
                old = []
            else:
                idle += 1
            old.append(moved)
            if not now.wants or idle > PATIENCE:
                break
            state = moved.select("blk", "ids", F.col("to").alias("com"), "k")
        return best, most

    def merged(self, state: DataFrame) -> DataFrame:
        """u, v, w between communities, by the ids of their nodes."""
        n, size = self.n, self.size

        def made(blk, ids, first, j, w, loops, com, k):
            i = np.repeat(com[blk * size : blk * size + len(ids)], np.diff(np.append(first, len(j))))
            key, place = np.unique(i.astype(np.int64) * n + com[j], return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key // n), pa.array(key % n), pa.array(np.bincount(place, w))], names=["cu", "cv", "w"])

        u, v = (self.numbered.table.select(F.col("at").alias(f"c{c}"), F.col("id").alias(c)) for c in "uv")
        return self._each(state, made, "cu long, cv long, w double").groupBy("cu", "cv").agg(F.sum("w").alias("w")).join(u, "cu").join(v, "cv").select("u", "v", "w")


def _packed(edges: DataFrame, total: float) -> Blocks | None:
    """The graph in blocks; None if these would be too large."""
    numbered = Numbered(edges.select("u").distinct(), "u")
    if numbered.n > NODES:
        return None
    out = Blocks(edges, numbered, total)
    if out.largest > ENDS:
        return None
    out.pack()
    return out


def communities(edges: DataFrame, weighted: bool = False, small: int = SMALL) -> DataFrame:
    """id, community of each node with an edge (u, v, weight); by connectivity alone, unless weights are strengths. Communities are
    numbered from 0 by their smallest node. Up to `small` edges the driver moves node after node; a larger graph's nodes move at
    once. An edge that repeats counts each time; nulls and weights that are not positive are left out."""
    plain = edges.select("u", "v", (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w")).where("u is not null and v is not null and w > 0")
    first = pinned(_both_ways(plain), "edges")
    home, at, level, last, whole = None, first, 0, -1.0, None
    while True:
        n = at.agg(F.count("*").alias("n"), F.sum("w").alias("total")).first()
        if n.n <= 2 * small:
            rows = at.where("u <= v").orderBy("u", "v").toArrow()  # `small` edges at most
            ends = list(zip(*(rows[c].to_pylist() for c in ("u", "v", "w"))))
            found = louvain([(u, v, w / 2 if u == v else w) for u, v, w in ends])
            low = _least(found)
            nodes = at.sparkSession.createDataFrame([(i, low[c]) for i, c in found.items()], "id long, com long")
            merged = 0
        else:
            graph = _packed(at, n.total)
            whole = whole if level else graph
            if graph:
                state, q = graph.settled(graph.alone())
                nodes = pinned(graph.homes(state), "nodes")
            else:
                nodes, q = _settled(at, pinned(_alone(at), "nodes"), n.total)
            merged = q - last if q > last + RISE else 0
            last = max(last, q)
        home = nodes.select("id", "com") if home is None else home.join(nodes.select(F.col("id").alias("com"), F.col("com").alias("top")), "com").select("id", F.col("top").alias("com"))
        home = pinned(home, "home")
        if not merged:
            break
        at, level = pinned(graph.merged(state) if graph else _merged(at, nodes), "edges"), level + 1
    if level and whole:
        home = pinned(whole.homes(whole.settled(pinned(whole.at(home), "nodes"))[0]), "home")
    elif level:
        k = _alone(first).select("id", "k", "loop")
        home = _settled(first, pinned(home.join(k, "id"), "nodes"), first.agg(F.sum("w")).first()[0])[0]
    lows = pinned(home.groupBy("com").agg(F.min("id").alias("low")), "lows")
    numbers = running(lows.withColumn("one", F.lit(1)), "low", ["one"]).select("com", (F.col("cum_one") - 1).cast("int").alias("community"))
    return matched(home.select("id", "com"), numbers, ["com"], "inner", lows.count() <= BROADCAST_KEYS).select("id", "community")


def _least(found: dict[int, int]) -> dict[int, int]:
    """Community -> its smallest node."""
    low: dict[int, int] = {}
    for n in sorted(found):
        low.setdefault(found[n], n)
    return low


def modularity(edges: DataFrame, found: DataFrame, weighted: bool = False) -> float:
    """How much more weight lies within the communities (id, community) than their degrees would give, as a share."""
    e = pinned(_both_ways(edges.select("u", "v", (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w"))), "edges")
    a, b = (found.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in "uv")
    r = e.join(a, "u").join(b, "v").groupBy("cu").agg(F.sum("w").alias("mass"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside")).agg(F.sum("inside"), F.sum(F.col("mass") * F.col("mass")), F.sum("mass")).first()
    return r[0] / r[2] - r[1] / r[2] / r[2]
