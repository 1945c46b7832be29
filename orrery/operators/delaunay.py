"""Delaunay triangulations of any number of points in the plane, by tiles that take in points of others until they know enough.

A tile triangulates its own points and those it has of others. A triangle at one of its own points counts when no point of the
whole table lies in its circle, and so does an edge of the hull, whose circle is a half-plane. A circle that reaches other tiles is asked in the
nearest of them, and where no circle of a tile has points there, in all that it reaches; the nearest points in it are added, until
none has any. Signs of determinants are exact. Of points on one circle, lesser ids count as lifted by more, so that all tiles
choose the same diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..session import pinned
from .order import percentiles
from .ranks import coarse, part_of, running

#: Points of a tile, about; tiles that a circle is asked in first.
TILE, NEAREST = 250, 8
#: Width of what a tile has of its neighbours from the start, in mean distances between points of the tile with the lesser ones.
MARGIN = 3.0


def orientation(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact sign, for each row, of the turn a, b, p: 1 to the left."""
    a, b, p = np.broadcast_arrays(a, b, p)
    one, two = (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0])
    sign = np.sign(one - two).astype(int)
    size = np.abs(one) + np.abs(two)
    for i in np.flatnonzero((np.abs(one - two) <= 1e-15 * size) & (size > 0)):
        (ax, ay), (bx, by), (px, py) = (map(Fraction, map(float, v[i])) for v in (a, b, p))
        d = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        sign[i] = (d > 0) - (d < 0)
    return sign


def inside(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether, for each row, p lies in the circle of the triangle a, b, c, which turns left. ids: of a, b, c, p, in columns."""
    a, b, c, p = np.broadcast_arrays(a, b, c, p)
    (ax, ay), (bx, by), (cx, cy) = ((v - p).T for v in (a, b, c))
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    parts = ((bx * cy, by * cx, sa), (cx * ay, cy * ax, sb), (ax * by, ay * bx, sc))
    det = sum((u - v) * s for u, v, s in parts)
    bound = 1e-14 * sum((np.abs(u) + np.abs(v)) * s for u, v, s in parts)
    out = det > 0
    for i in np.flatnonzero(np.abs(det) <= bound):
        px, py = map(Fraction, map(float, p[i]))
        xs = [(Fraction(float(v[i, 0])) - px, Fraction(float(v[i, 1])) - py) for v in (a, b, c)]
        s = [x * x + y * y for x, y in xs]
        cross = lambda j, k: xs[j][0] * xs[k][1] - xs[j][1] * xs[k][0]
        minors = [cross(1, 2), cross(2, 0), cross(0, 1)]  # what lifting a, b or c adds
        exact = sum(m * t for m, t in zip(minors, s))
        if not exact:
            minors.append(-sum(minors))
            exact = next(minors[j] for j in np.argsort(ids[i]) if minors[j])
        out[i] = exact > 0
    return out


def triangles(p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Triangles (a, b, c), each turning left, of distinct points, as positions; -1 stands for the point beyond an edge of the
    hull, always last. None where all points are on one line."""
    n, order = len(p), np.lexsort((ids, p[:, 1], p[:, 0]))
    start = next((k for k in range(2, n) if orientation(p[order[0]], p[order[1]], p[order[k]][None])[0]), None) if n > 2 else None
    if start is None:
        return np.empty((0, 3), int)
    a, b, c = order[0], order[1], order[start]
    if orientation(p[a], p[b], p[c][None])[0] < 0:
        a, b = b, a
    t, used = np.empty((8 * n + 16, 3), int), 4
    t[:4] = [(a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)]
    live = np.zeros(len(t), bool)
    live[:4] = True
    rest = np.random.default_rng(0).permutation([k for k in order if k not in (a, b, c)])
    for i in rest:
        if used + 64 > len(t):  # what is gone is dropped
            kept = t[:used][live[:used]]
            t = np.concatenate([kept, np.empty((8 * n + 16, 3), int)])
            used = len(kept)
            live = np.zeros(len(t), bool)
            live[:used] = True
        at = np.flatnonzero(live[:used])
        hit = at[holds(p, ids, t[at], p[i], ids[i])]
        sides = {}
        for u, v, w in t[hit].tolist():
            for s in ((u, v), (v, w), (w, u)):
                if s[::-1] in sides:
                    del sides[s[::-1]]
                else:
                    sides[s] = True
        live[hit] = False
        fresh = [(u, v, i) if u >= 0 <= v else (v, i, -1) if u < 0 else (i, u, -1) for u, v in sides]
        if used + len(fresh) > len(t):
            t, live = np.concatenate([t, np.empty((len(fresh) + 8 * n, 3), int)]), np.concatenate([live, np.zeros(len(fresh) + 8 * n, bool)])
        t[used : used + len(fresh)] = fresh
        live[used : used + len(fresh)] = True
        used += len(fresh)
    return t[:used][live[:used]]


def beyond(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether, for each row, p lies left of the edge a, b, or on it between its ends."""
    a, b, p = np.broadcast_arrays(a, b, p)
    side = orientation(a, b, p)
    between = ((p - a) * (p - b)).sum(axis=1) < 0
    return (side > 0) | ((side == 0) & between)


def holds(p: np.ndarray, ids: np.ndarray, t: np.ndarray, x: np.ndarray, id_: int) -> np.ndarray:
    """Which of the triangles have the point x in their circles."""
    out, real = np.zeros(len(t), bool), t[:, 2] >= 0
    r = t[real]
    out[real] = inside(p[r[:, 0]], p[r[:, 1]], p[r[:, 2]], x, np.c_[ids[r], np.full(len(r), id_)])
    g = t[~real]
    out[~real] = beyond(p[g[:, 0]], p[g[:, 1]], x)
    return out


def _shared(tile: int, t: pa.Table, boxes: np.ndarray, margins: np.ndarray) -> pa.Table:
    """A tile's points (tile, id, x, y) near other tiles, with these tiles' numbers."""
    p, out = np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1), []
    wide = np.minimum(margins, margins[tile])[:, None]
    low, high = boxes[:, :2] - wide, boxes[:, 2:] + wide
    for other in np.flatnonzero((low <= boxes[tile, 2:]).all(axis=1) & (high >= boxes[tile, :2]).all(axis=1)).tolist():
        at = np.flatnonzero((p >= low[other]).all(axis=1) & (p <= high[other]).all(axis=1)) if other != tile else []
        if len(at):
            out.append(pa.table({"tile": pa.array([other] * len(at), pa.int32()), "id": t["id"].take(pa.array(at)), "x": p[at, 0], "y": p[at, 1]}))
    return pa.concat_tables(out) if out else t.slice(0, 0).select(["tile", "id", "x", "y"])


def _by_distance(tiles: np.ndarray, boxes: np.ndarray, at: np.ndarray) -> list[int]:
    (x0, y0, x1, y1) = boxes[tiles].T
    return tiles[np.argsort(np.hypot(np.maximum(np.maximum(x0 - at[0], at[0] - x1), 0), np.maximum(np.maximum(y0 - at[1], at[1] - y1), 0)))].tolist()


def _reach(box: np.ndarray, boxes: np.ndarray, corners: np.ndarray, real: bool) -> np.ndarray:
    """Tiles (boxes: x0, y0, x1, y1) that a circle, or a half-plane left of an edge, may reach, besides its own."""
    (x0, y0, x1, y1), a, b = boxes.T, corners[0], corners[1]
    if not real:
        d = b - a
        high = np.maximum(d[0] * (y0 - a[1]), d[0] * (y1 - a[1])) - np.minimum(d[1] * (x0 - a[0]), d[1] * (x1 - a[0]))
        return high >= -1e-9 * (np.abs(d[0]) * (np.abs(y0 - a[1]) + np.abs(y1 - a[1])) + np.abs(d[1]) * (np.abs(x0 - a[0]) + np.abs(x1 - a[0])))
    u, v = b - a, corners[2] - a
    area = 2 * (u[0] * v[1] - u[1] * v[0])
    uu, vv = u @ u, v @ v
    if area <= 1e-6 * (uu + vv):  # too flat for its centre to be known well
        return np.ones(len(boxes), bool)
    o = a + np.array([v[1] * uu - u[1] * vv, u[0] * vv - v[0] * uu]) / area
    r = float(np.hypot(*(o - a))) * (1 + 1e-6)
    if o[0] - r > box[0] and o[1] - r > box[1] and o[0] + r < box[2] and o[1] + r < box[3]:
        return np.zeros(len(boxes), bool)
    dx, dy = np.maximum(np.maximum(x0 - o[0], o[0] - x1), 0), np.maximum(np.maximum(y0 - o[1], o[1] - y1), 0)
    return dx * dx + dy * dy <= r * r


#: A tile's edges at its own points, and circles that are to be asked in a target; late: only after those that are nearer.
STAR = "late boolean, tile int, target int, u long, v long, weight double, circle array<double>, ids array<long>, own array<boolean>"


def edges(points: DataFrame, size: int = TILE) -> DataFrame:
    """u, v, weight: Delaunay edges of points (id, x, y), all of them in different places, and their lengths."""
    spark = points.sparkSession
    held = pinned(points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    s = held.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"), F.min(F.struct("x", "y", "id")).alias("first"), F.max(F.struct("x", "y", "id")).alias("last")).first()
    if s.n < 2:
        return spark.createDataFrame([], "u long, v long, weight double")
    first, last = s.first, s.last
    line = (np.array([[first.x, first.y]]), np.array([[last.x, last.y]]))

    def off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(orientation(*line, np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)) != 0))

    third = held.mapInArrow(off, held.schema).agg(F.min(F.struct("id", "x", "y")).alias("p")).first().p
    if third is None:  # all on one line, in order of x and y
        by = "x" if s.max_x - s.min_x >= s.max_y - s.min_y else "y"
        placed = running(held.withColumn("one", F.lit(1)), by, ["one"])
        after = placed.select((F.col("cum_one") - 1).alias("cum_one"), F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return placed.join(after, "cum_one").select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v"), F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("weight"))
    own, boxes, margins = _tiles(held, s, size)
    # three points that are not on one line, so that every tile has a triangle
    seeds = spark.createDataFrame([(r.id, r.x, r.y) for r in (first, last, third)], "id long, x double, y double")
    tiles = own.select("tile").distinct()
    table = spark.sparkContext.broadcast((boxes, margins))
    edge = own.groupBy("tile").applyInArrow(lambda key, t: _shared(key[0].as_py(), t, *table.value), "tile int, id long, x double, y double")
    extra = pinned(tiles.crossJoin(F.broadcast(seeds)).unionByName(edge), "extra")

    def star(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        tile, all_boxes = key[0].as_py(), table.value[0]
        t = t.sort_by([("id", "ascending"), ("own", "descending")])
        ids, mine = t["id"].to_numpy(), t["own"].to_numpy()
        once = np.r_[True, ids[1:] != ids[:-1]]
        ids, mine = ids[once], mine[once]
        p = np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1)[once]
        f = triangles(p, ids)
        f = f[np.where(f >= 0, mine[f], False).any(axis=1)]
        rows, seen = [], set()
        for row in f.tolist():
            corners = p[[k for k in row if k >= 0]]
            reach = _reach(all_boxes[tile], all_boxes, corners, row[2] >= 0)
            reach[tile] = False
            ring = [k for k in row if k >= 0]
            for place, target in enumerate(_by_distance(np.flatnonzero(reach), all_boxes, p[ring][mine[ring]][0])):
                rows.append((place >= NEAREST, tile, target, None, None, None, corners.ravel().tolist(), ids[ring].tolist(), mine[ring].tolist()))
            for a, b in ((0, 1), (1, 2), (2, 0)):
                u, v = sorted((row[a], row[b]))  # positions are in order of id
                if u >= 0 and mine[u] and (u, v) not in seen:
                    seen.add((u, v))
                    rows.append((None, tile, None, int(ids[u]), int(ids[v]), float(np.hypot(*(p[u] - p[v]))), None, None, None))
        kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        names = ["late", "tile", "target", "u", "v", "weight", "circle", "ids", "own"]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({m: pa.array(c, k) for m, c, k in zip(names, columns, kinds)})

    def found(circles: pa.Table, t: pa.Table) -> pa.Table:
        p, pid = np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1), t["id"].to_numpy()
        out = set()
        for tile, flat, ids, mine in zip(*(circles[c].to_pylist() for c in ("tile", "circle", "ids", "own"))):
            q = np.array(flat).reshape(-1, 2)
            here = inside(q[[0]], q[[1]], q[[2]], p, np.c_[np.tile(ids, (len(p), 1)), pid]) if len(q) == 3 else beyond(q[[0]], q[[1]], p)
            at = np.flatnonzero(here & ~np.isin(pid, ids))
            if len(at):
                out |= {(tile, int(at[((p[at] - q[k]) ** 2).sum(axis=1).argmin()])) for k in range(len(q)) if mine[k]}
        at = np.array([k for _, k in out], int)
        return pa.table({"tile": pa.array([k for k, _ in out], pa.int32()), "id": pid[at], "x": p[at, 0], "y": p[at, 1]})

    def answered(circles: DataFrame) -> DataFrame:
        met = circles.select("target", "tile", "circle", "ids", "own").groupBy("target").cogroup(own.groupBy("tile"))
        return met.applyInArrow(found, "tile int, id long, x double, y double").distinct()

    done = None
    while True:
        points_of = own.join(tiles, "tile", "left_semi").withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False)))
        stars = pinned(points_of.groupBy("tile").applyInArrow(star, STAR), "stars")
        near = pinned(answered(stars.where("not late")), "found")
        far = pinned(answered(stars.where("late").join(near.select("tile").distinct(), "tile", "left_anti")), "found")
        more = near.unionByName(far)
        open_ = more.select("tile").distinct()
        settled = stars.where("late is null").join(open_, "tile", "left_anti").select("u", "v", "weight")
        done = settled if done is None else done.unionByName(settled)
        if not more.count():
            return done
        tiles = open_
        extra = pinned(extra.join(open_, "tile", "left_semi").unionByName(more), "extra")


def _tiles(held: DataFrame, s, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(tile, id, x, y), in strips of x that are cut by y, so that tiles are about square; each tile's box; and its margin."""
    many = max(1, -(-s.n // size))
    wide, high = s.max_x - s.min_x, s.max_y - s.min_y
    strips = int(min(max(round((many * wide / high) ** 0.5) if high else many, 1), many))
    each = -(-many // strips)

    def cut(rows: DataFrame, value: str, parts: int, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).alias("cuts"))

    def dealt(rows: DataFrame, value: str, parts: int, name: str) -> DataFrame:
        step = max(2, int(parts**0.5))
        return rows.withColumn(name, part_of(F.col(value), F.col("cuts"), coarse(F.col("cuts"), step), step).cast("int") if parts > 1 else F.lit(0)).drop("cuts")

    in_strip = dealt(held.crossJoin(F.broadcast(cut(held, "x", strips, []))), "x", strips, "strip")
    in_strip = pinned(in_strip, "strips")
    both = dealt(in_strip.join(F.broadcast(cut(in_strip, "y", each, ["strip"])), "strip"), "y", each, "row")
    own = pinned(both.select((F.col("strip") * each + F.col("row")).alias("tile"), "id", "x", "y"), "tiles")
    corner = held.select("x", "y").first()
    boxes = np.tile([corner.x, corner.y] * 2, (strips * each, 1))  # of a tile without points: a place of another's
    margins = np.zeros(len(boxes))
    for r in own.groupBy("tile").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).collect():  # a row a tile
        boxes[r[0]] = r[1:5]
        margins[r[0]] = MARGIN * ((r[3] - r[1]) * (r[4] - r[2]) / r[5]) ** 0.5
    return own, boxes, margins


def delaunay_graph(points: DataFrame, id_col: str, x: str, y: str, longest: float = 1.5, size: int = TILE) -> DataFrame:
    """u, v, weight: Delaunay edges up to longest times their median length. Of points in one place the least id stands for all; points
    without finite coordinates have no edges."""
    rows = points.select(F.col(id_col).cast("long").alias("id"), finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    all_ = pinned(edges(rows.groupBy("x", "y").agg(F.min("id").alias("id")), size), "edges")
    bound = percentiles(all_, "weight", [0.5]).select((longest * F.get("q", F.lit(0))).alias("bound"))
    return all_.crossJoin(F.broadcast(bound)).where("weight <= bound").drop("bound")
