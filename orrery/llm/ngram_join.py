"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; each pair verified once.

Documents with equal shingle sets form a class; classes are joined, not copies. A link needs an overlap of at least
ceil(t / (1 + t) * (n1 + n2)) shingles, so two linked classes share one of their floor((1 - t) * n) + 1 rarest. Rarity is
a document frequency over the whole corpus, kept in a sketch of fixed size; any order is correct, a rare-first one is fast.

Components come first, without a row for each pair: classes that share a prefix shingle meet at a few hubs of it, then
the components so far meet at the largest one, and at last all components that still share a prefix shingle and have not
been compared meet. Components meet in blocks of sets, in which the length and suffix filters leave the pairs that are
verified. Links are then counted inside the components, again in blocks, each pair of classes once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, small_batches, staged

#: Words of a shingle; similarity as a fraction.
WORDS, NUM, DEN = 5, 3, 4
#: Cells of the frequency sketch and the pieces in which it is summed; hash ranges of the suffix filter; words that a worker remembers; rows that are broadcast at most.
CELLS, CHUNKS, RANGES, CACHE_WORDS, BROADCAST_ROWS = 1 << 20, 32, 32, 100_000, 500_000
#: Rounds in which components meet at hubs, and how many partners each has in a round. Then all that are left meet.
ROUNDS, PARTNERS = 2, 3
#: Classes, and shingles of them, that a block holds on average; entries of a frequent token that are sorted together, about.
BLOCK_CLASSES, BLOCK_SHINGLES, TOKEN_ENTRIES = 256, 250_000, 4096

_WEIGHTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class WordHash(dict):
    """Word in UTF-8 -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = WordHash()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; one of the whole sequence if it has fewer words; none without words.

    A-Z are lower-cased, words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * np.uint64(_WEIGHTS[i])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


class Keys:
    """Keys of sets: 64 bits of a 128-bit hash. Where the corpus has several sets of one key, they go by the other 64 bits."""

    def __init__(self, taken: frozenset[int] = frozenset(), bits: int = 64):
        self.taken, self.mask = taken, (1 << bits) - 1

    def both(self, found: np.ndarray) -> tuple[int, int]:
        """Key and other key, signed."""
        h = xxhash.xxh3_128_intdigest(found.tobytes())
        first, other = h & self.mask, h >> 64
        return (first ^ 1 << 63) - (1 << 63), (other ^ 1 << 63) - (1 << 63)

    def __call__(self, found: np.ndarray) -> int:
        key, other = self.both(found)
        return other if key in self.taken else key


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(44)).astype(np.int64)


def profiles(docs: DataFrame, keys: Keys) -> DataFrame:
    """For each document doc_id, key (hash of the text), n, cls and other (keys of its set; null if n is 0); besides, for each
    task, rows of chunk, counts: its part of the frequency sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("other", pa.int64()), ("chunk", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            n, both, cells = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py())
                n.append(len(found))
                both.append(keys.both(found) if len(found) else (None, None))
                cells.append(_cells(found))
            if cells:
                counts += np.bincount(np.concatenate(cells), minlength=CELLS).astype(np.uint32)
                salt = (salt + sum(n)) % 1024
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array([b[i] for b in both], pa.int64()) for i in (0, 1)), *(none.cast(f.type) for f in list(schema)[5:])], schema=schema)
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, CHUNKS)]
        none = pa.nulls(CHUNKS)
        yield pa.RecordBatch.from_arrays([*(none.cast(f.type) for f in list(schema)[:5]), pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(profiled, "doc_id long, key long, n long, cls long, other long, chunk int, salt int, counts binary")


def classes_of(base: DataFrame) -> DataFrame:
    """cls, rep_id and rep_key (one of its rows, that with the least doc_id, nulls last), n, copies, several (whether different sets have this key)."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    found = base.where("cls is not null").groupBy("cls").agg(rep, F.first("n").alias("n"), F.count("*").alias("copies"), (F.min("other") != F.max("other")).alias("several"))
    return found.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key"), "n", "copies", "several")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(counts), np.uint32)
            old = sums.get(chunk)
            sums[chunk] = part if old is None else np.where(part > ~old, np.uint32(0xFFFFFFFF), old + part)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["chunk", "counts"])


def frequency_sketch(profiled: DataFrame) -> np.ndarray:
    """Documents by cell of a shingle's hash: CELLS counters, whatever the input's size. Summed in two steps, so no task reads all."""
    parts = profiled.where("chunk is not null").select("chunk", "salt", "counts")
    once = parts.repartition("chunk", "salt").select("chunk", "counts").mapInArrow(_summed, "chunk int, counts binary")
    twice = once.repartition("chunk").mapInArrow(_summed, "chunk int, counts binary")
    out = np.zeros(CELLS, np.uint32).reshape(CHUNKS, -1)
    for row in twice.toLocalIterator():
        out[row.chunk] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return out.reshape(-1)


def prefix_entries(docs: DataFrame, sketch: np.ndarray, keys: Keys) -> DataFrame:
    """token, cls, n, pos, part: each class's rarest shingles, as many as a linked class cannot avoid. A task gives a class
    once or more. part deals the entries of a token that the sketch shows to be frequent; it is 0 for others."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("part", pa.int32())])
    usual = 2 * int(sketch.mean(dtype=np.float64)) + TOKEN_ENTRIES

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, done = shared.value, set()
        for batch in batches:
            tokens, counts, classes, sizes = [], [], [], []
            for text in batch.column(0):
                found = shingle_set(text.as_py())
                if not len(found) or (cls := keys(found)) in done:
                    continue
                if len(done) >= 200_000:
                    done.clear()
                done.add(cls)
                length = len(found) - -(-NUM * len(found) // DEN) + 1
                often = frequency[_cells(found)]
                first = np.argsort(often, kind="stable")[:length]
                tokens.append(found[first])
                counts.append(often[first])
                classes.append(cls)
                sizes.append(len(found))
            if tokens:
                lengths = [len(t) for t in tokens]
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                cls = np.repeat(np.array(classes, np.int64), lengths)
                parts = np.maximum(np.concatenate(counts).astype(np.int64) - usual, -1) // TOKEN_ENTRIES + 1
                part = np.where(parts > 0, 1 + (cls & 0xFFFFFFFF) % np.maximum(parts, 1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(cls), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(pos), pa.array(part)], schema=schema)

    return docs.select("text").mapInArrow(entries, "token long, cls long, n int, pos int, part int")


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries whose token several classes have, once each; of a token dealt into parts all."""
    by, whole = Window.partitionBy("token", "part").orderBy("n", "cls"), Window.partitionBy("token", "part")
    several = (F.col("part") > 0) | (F.min("cls").over(whole) != F.max("cls").over(whole))
    seen = entries.select("token", "cls", "n", "pos", F.lag("cls").over(by).alias("before"), several.alias("several"))
    return seen.where("several and (before is null or before <> cls)").drop("several", "before")


def _passes(one: dict[str, Column], two: dict[str, Column]) -> Column:
    """Length and positional filters, exact in integers, for groups of classes: lo and hi are the least and largest size, rest
    the most shingles from the shared one on. For the first shingle that two classes share, the overlap is at most what
    is left there on the shorter side."""
    fits = (NUM * one["lo"] <= DEN * two["hi"]) & (NUM * two["lo"] <= DEN * one["hi"])
    return fits & ((NUM + DEN) * F.least(one["rest"], two["rest"]) >= NUM * (one["lo"] + two["lo"]))


_GROUP = ("size", "mass", "lo", "hi", "rest")


def bounded(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def single_groups(shared: DataFrame) -> DataFrame:
    """token, comp and _GROUP, where each class is a component."""
    n = F.col("n").cast("bigint")
    return shared.select("token", F.col("cls").alias("comp"), F.lit(1).cast("bigint").alias("size"), n.alias("mass"), n.alias("lo"), n.alias("hi"), (n - F.col("pos")).alias("rest"))


def joined_groups(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """groups, with those of a token that are now in one component as one; of the tokens that several components have."""
    known = groups.join(bounded(comps.select(F.col("node").alias("comp"), "component", F.col("size").alias("now"), F.col("mass").alias("now_mass"))), "comp", "left")
    same = known.groupBy("token", F.coalesce("component", "comp").alias("comp")).agg(F.max(F.coalesce("now", "size")).alias("size"), F.max(F.coalesce("now_mass", "mass")).alias("mass"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"))
    same = staged(same, "same")
    several = same.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    out = staged(same.join(several.select("token"), "token", "left_semi"), "groups")
    discard(same)
    return out


def hub_tests(groups: DataFrame, seed: int) -> DataFrame:
    """x, hub and their sizes and masses: components that meet at their tokens' hubs, which are the largest component, the one
    with the smallest class and one at random. A few rows for each group, however many groups a token has."""
    me = F.struct("comp", *_GROUP)
    chosen = [F.max_by(me, F.struct("size", F.xxhash64("comp", F.lit(seed)))), F.min_by(me, F.struct("lo", "comp")), F.min_by(me, F.xxhash64("comp", F.lit(seed + 1)))]
    hubs = groups.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("hubs"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").drop("a", "b")
    own = {c: F.col(c) for c in _GROUP}
    meets = F.filter("hubs", lambda h: (h["comp"] != F.col("comp")) & _passes(own, {c: h[c] for c in _GROUP}))
    met = groups.join(hubs, "token").select(F.col("comp").alias("x"), "size", "mass", F.explode(meets).alias("h"))
    return met.groupBy("x", F.col("h.comp").alias("hub")).agg(F.max("size").alias("x_size"), F.max("mass").alias("x_mass"), F.max("h.size").alias("hub_size"), F.max("h.mass").alias("hub_mass"), F.count("*").alias("votes"))


def best_tests(tests: DataFrame) -> DataFrame:
    """Each component's PARTNERS tests with the most tokens; of two components that are each other's hub one test."""
    rank = Window.partitionBy("x").orderBy(F.desc("votes"), "hub")
    best = tests.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PARTNERS).drop("r")
    either = F.min(F.struct("x_size", "x", *(c for c in best.columns if c not in ("x_size", "x")))).alias("t")
    return best.groupBy(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b")).agg(either).select(*(f"t.{c}" for c in best.columns))


def all_tests(groups: DataFrame) -> DataFrame:
    """x, hub as in hub_tests for all components that share a token and pass the filters; the larger one is the hub."""
    one, two = (groups.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("comp", *_GROUP))) for i in (1, 2))
    side = [{c: F.col(f"{c}{i}") for c in _GROUP} for i in (1, 2)]
    met = one.join(two, "token").where((F.col("comp1") < F.col("comp2")) & _passes(*side))
    first = F.col("size1") >= F.col("size2")
    pick = lambda c, larger: F.when(first == larger, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return met.select(pick("comp", False).alias("x"), pick("comp", True).alias("hub"), pick("size", False).alias("x_size"), pick("mass", False).alias("x_mass"), pick("size", True).alias("hub_size"), pick("mass", True).alias("hub_mass")).distinct().withColumn("votes", F.lit(1).cast("bigint"))


def untested(tests: DataFrame, done: list[DataFrame]) -> DataFrame:
    """tests less those done before between the same components: components only grow, so equal names and sizes are equal members."""
    for old in done:
        for x, hub in (("x", "hub"), ("hub", "x")):
            known = old.select(F.col(x).alias("x"), F.col(hub).alias("hub"), F.col(f"{x}_size").alias("x_size"), F.col(f"{hub}_size").alias("hub_size"))
            tests = tests.join(known, ["x", "hub", "x_size", "hub_size"], "left_anti")
    return tests


def _parts(size: Column, mass: Column) -> Column:
    """Blocks that a component's classes are dealt into."""
    return F.greatest(F.ceil(size / BLOCK_CLASSES), F.ceil(mass / BLOCK_SHINGLES), F.lit(1)).cast("bigint")


def members(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows (comp, ...) with cls: a row for each class of the component."""
    if comps is None:
        return rows.withColumn("cls", F.col("comp"))
    many = comps.select("component", "node")
    return rows.join(many, rows["comp"] == many["component"], "left").withColumn("cls", F.coalesce("node", "comp")).drop("component", "node")


def _in(parts: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit("block")), parts)


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))


def met_in_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (at, l, r, side, cls, comp) with their sets, those of a meeting (at, l, r) together and in one task."""
    found = sets.join(bounded(staged(rows, "meetings")), "cls").select("at", "l", "r", "side", "cls", "comp", "copies", "shingles")
    return found.repartition("at", "l", "r").sortWithinPartitions("at", "l", "r")


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[tuple], list[tuple]]]:
    """Of each meeting its key and, of either side, (cls, comp, copies, set)."""
    now, sides = None, ([], [])
    for batch in batches:
        small = [c.to_pylist() for c in batch.columns[:7]]
        for at, l, r, side, cls, comp, copies, shingles in zip(*small, batch.column(7)):  # noqa: E741
            if (at, l, r) != now:
                if now:
                    yield now, *sides
                now, sides = (at, l, r), ([], [])
            sides[side].append((cls, comp, copies, np.frombuffer(shingles.as_py(), np.uint64)))
    if now:
        yield now, *sides


def links_between(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the sets on either side link: 100 * intersection >= 75 * union, in integers. Pairs that pass the length filter
    and the suffix filter are verified: what differs between two sets is at least the sum, over fixed ranges of the hash,
    of the difference of their counts there."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    spread = [np.stack([np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=RANGES) for s in side]).astype(np.int32) for side in (left, right)]
    n1, n2 = sizes[0][:, None], sizes[1][None, :]
    fits = (NUM * n1 <= DEN * n2) & (NUM * n2 <= DEN * n1)
    apart = np.abs(spread[0][:, None, :] - spread[1][None, :, :]).sum(axis=2)
    fits &= (NUM + DEN) * (n1 + n2 - apart) >= 2 * NUM * (n1 + n2)
    out = np.zeros(fits.shape, bool)
    if fits.sum() <= 4 * len(left):
        for i, j in zip(*np.nonzero(fits)):
            both = len(np.intersect1d(left[i], right[j], assume_unique=True))
            out[i, j] = DEN * both >= NUM * (sizes[0][i] + sizes[1][j] - both)
        return out
    known, at = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes[1])[:-1]])
    has = np.zeros(len(known) + 1, bool)
    for i in np.flatnonzero(fits.any(axis=1)):
        places = np.searchsorted(known, left[i])
        places = places[known[np.minimum(places, len(known) - 1)] == left[i]]
        has[places] = True
        both = np.add.reduceat(has[at], starts, dtype=np.int64)
        has[places] = False
        out[i] = fits[i] & (DEN * both >= NUM * (sizes[0][i] + sizes[1] - both))
    return out


def linked_components(tests: DataFrame, comps: DataFrame | None, sets: DataFrame) -> DataFrame:
    """a, b: the tested components between which there is a link. sets: cls, copies, shingles."""
    hubs = tests.groupBy("hub").agg(F.sum("x_size").alias("xs"), F.sum("x_mass").alias("x_mass"), F.max("hub_size").alias("ys"), F.max("hub_mass").alias("y_mass"))
    hubs = hubs.select(F.col("hub").alias("at"), _parts(F.col("xs"), F.col("x_mass")).alias("ls"), _parts(F.col("ys"), F.col("y_mass")).alias("rs"))
    left = members(tests.select(F.col("hub").alias("at"), F.col("x").alias("comp")).join(hubs, "at"), comps).select("at", _in(F.col("ls")).alias("l"), _every(F.col("rs")).alias("r"), F.lit(0).alias("side"), "cls", "comp")
    right = members(hubs.withColumn("comp", F.col("at")), comps).select("at", _every(F.col("ls")).alias("l"), _in(F.col("rs")).alias("r"), F.lit(1).alias("side"), "cls", "comp")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for (hub, _, _), xs, ys in meetings(batches):
            if xs and ys:
                hits = links_between([x[3] for x in xs], [y[3] for y in ys]).any(axis=1)
                found.update((x[1], hub) for x, hit in zip(xs, hits) if hit)
            if len(found) >= 10_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    return met_in_blocks(left.unionByName(right), sets).mapInArrow(compared, "a long, b long").distinct()


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def link_counts(comps: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, links: with how many documents of other classes those of a class link. Each pair of blocks of a component meets once."""
    parts = _parts(F.col("size"), F.col("mass"))
    dealt = comps.select(F.col("component").alias("at"), F.col("node").alias("cls"), F.col("component").alias("comp"), parts.alias("n"))
    dealt = dealt.select("at", "cls", "comp", _in(F.col("n")).alias("i"), _every(F.col("n")).alias("j"))
    rows = dealt.select("at", F.least("i", "j").alias("l"), F.greatest("i", "j").alias("r"), (F.col("i") > F.col("j")).cast("int").alias("side"), "cls", "comp")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), xs, ys in meetings(batches):
            ys = xs if i == j else ys
            if not xs or not ys:
                continue
            links = links_between([x[3] for x in xs], [y[3] for y in ys])
            if i == j:
                np.fill_diagonal(links, False)
            total: dict[int, int] = {}
            for side, other, hits in ((xs, ys, links), (ys, xs, links.T))[: 1 if i == j else 2]:
                weights = np.array([m[2] for m in other], np.int64)
                total |= {m[0]: k for m, k in zip(side, (hits @ weights).tolist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cls", "links"])

    return met_in_blocks(rows, sets).mapInArrow(counted, "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def class_sets(needed: DataFrame, docs: DataFrame, keys: Keys) -> DataFrame:
    """cls, copies, shingles: the set of each class needed (cls, rep_id, rep_key, copies), made again from its document."""
    count = needed.count()
    needed = F.broadcast(needed) if count <= BROADCAST_ROWS else needed
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = rows.join(needed, F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_key") == F.col("key"))).select("cls", "copies", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, tuple[int, bytes]] = {}
            for cls, copies, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if cls not in out and keys(found := shingle_set(text.as_py())) == cls:
                    out[cls] = copies, found.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.binary())], names=["cls", "copies", "shingles"])

    out = staged(found.mapInArrow(made, "cls long, copies long, shingles binary"), "sets")
    if out.count() == count:
        return out
    one = staged(out.groupBy("cls").agg(F.first("copies").alias("copies"), F.first("shingles").alias("shingles")), "sets")  # rows that repeat
    discard(out)
    return one


def near_duplicates(docs: DataFrame, count_links: bool = True, key_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, the own one included), n_links (other rows that
    it links with; left out without count_links), comp (names the component; null without words) and key (hash of the
    text) for each row of docs.

    Rows without words have n_shingles 0 and link with nothing: component_id is their doc_id. Null doc_ids
    count as larger than all; a component of only such rows has a null component_id. Repeated rows are linked as equals.
    An empty table gives no rows. Texts of any length are read whole; ties in rarity are broken by the hash, which no
    result depends on. Columns other than doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    keys = Keys(bits=key_bits)
    profiled = staged(profiles(docs, keys), "profiles")
    base = profiled.where("chunk is null").select("doc_id", "key", "n", "cls", "other")
    classes = staged(classes_of(base), "classes")
    taken = [r.cls for r in classes.where("several").select("cls").toLocalIterator()]  # N * N / 2 ** 65 keys of N classes
    if taken:
        keys = Keys(frozenset(taken), key_bits)
        base = base.withColumn("cls", F.when(F.col("cls").isin(taken), F.col("other")).otherwise(F.col("cls")))
        classes = staged(classes_of(base), "classes")
    shared = staged(shared_entries(prefix_entries(docs, frequency_sketch(profiled), keys)), "shared")
    links: list[DataFrame] = []
    done: list[DataFrame] = []
    sets: list[DataFrame] = []
    comps: DataFrame | None = None
    turn, last, groups = 0, ROUNDS == 0, single_groups(shared)
    while True:
        tests = untested(all_tests(groups) if last else hub_tests(groups, 2 * turn), done)
        tests = staged(tests if last else best_tests(tests), "tests")
        done.append(tests)
        found = None
        if not tests.isEmpty():
            # members of larger components have been fetched when they were single
            single = tests.where("x_size = 1").select(F.col("x").alias("cls")).unionByName(tests.where("hub_size = 1").select(F.col("hub").alias("cls"))).distinct()
            for old in sets:
                single = single.join(old.select("cls"), "cls", "left_anti")
            needed = staged(single.join(classes.select("cls", "rep_id", "rep_key", "copies"), "cls"), "needed")
            sets.append(class_sets(needed, docs, keys))
            found = staged(linked_components(tests, comps, reduce(DataFrame.unionByName, sets)), "links")
            discard(needed)
        if found is not None and not found.isEmpty():
            links.append(found)
            every = components(reduce(DataFrame.unionByName, links), "a", "b")
            sized = staged(every.join(classes.select(F.col("cls").alias("node"), "n"), "node"), "members")
            totals = sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("mass"))
            comps = staged(sized.join(totals, "component").select("node", "component", "size", "mass"), "components")
            old, groups = groups, joined_groups(groups, comps) if not last else groups
            discard(sized, *([old] if old is not groups else []))
        elif not last:
            last = True
            continue
        if last:
            break
        turn += 1
        last = turn == ROUNDS
    if comps is None:
        comps = spark.createDataFrame([], "node long, component long, size long, mass long")
    named = classes.join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "rep_id", "copies", F.coalesce("component", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep_id").alias("least"))
    named = named.join(least, "comp")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")]
    if count_links:
        counted = link_counts(comps, reduce(DataFrame.unionByName, sets)) if sets else spark.createDataFrame([], "cls long, links long")
        named = named.join(counted, "cls", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("bigint")))
        out.append(F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    named = staged(named, "named")
    discard(shared, groups, *sets, *done, *links)
    return base.join(named.drop("rep_id", "copies"), "cls", "left").select(*out, "comp", "key")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates: of each component the document with the smallest
    doc_id, one row of it. Rows without words stay. Components of null doc_ids alone keep one row. Other columns may have
    any names; an empty table stays empty."""
    found = staged(near_duplicates(docs, count_links=False).where("comp is not null").select("doc_id", "key", "comp"), "found")
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    rows = found.groupBy("comp", "doc_id", "key").count().join(best, "comp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    judged = staged(rows.where("not stays or count > 1").select("doc_id", "key", "stays"), "judged")
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key"))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    left = keyed.join(bounded(judged.where("not stays")), match, "left_anti")
    repeats = judged.where("stays")
    if not repeats.isEmpty():
        again = bounded(repeats)
        left = left.join(again, match, "left_anti").unionByName(left.join(again, match, "left_semi").dropDuplicates(["id", "text_key"]))
    return left.select("row.*")
