import random

import pytest

from orrery.llm import components, ngram_join


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n, component) by comparing all pairs."""
    found = [sets(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if found[i] and 100 * len(found[i] & found[j]) >= 75 * len(found[i] | found[j]):
                top[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    links = [sum(j != i and bool(f) and 100 * len(f & g) >= 75 * len(f | g) for j, g in enumerate(found)) for i, f in enumerate(found)]
    return sorted(((d, len(found[i]), ids.get(root(i)) if found[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.choice([1, 3, 5, 6, 8, 30, 80, 200])) for _ in range(30)]
    rows = [*base]
    for _ in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    passage = text(60)
    rows += [f"{passage} {text(20)}" for _ in range(10)] + [passage, "", "   ", None, "\tA b\nc D e ", "a b c d e", "é à b c d", "x " * 3000]
    ids = list(range(1000, 1000 + len(rows)))
    rng.shuffle(ids)
    out = list(zip(ids, rows))
    return out + [out[0], out[5], (None, rows[3]), (None, None)]


def joined(docs, **given):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(docs, **given).collect()), key=repr)


@pytest.mark.parametrize("rounds, block, bits", [(0, 256, 64), (1, 3, 64), (3, 5, 6)])
def test_against_all_pairs(spark, monkeypatch, rounds, block, bits):
    """Also with blocks of a few classes, and with keys so short that different sets have the same."""
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rows = corpus(rounds)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs.selectExpr("doc_id", "text", "'x' as n", "1 as cls"), key_bits=bits) == brute(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Some copies link with few others only; no pair is lost, and frequent tokens are dealt into parts."""
    monkeypatch.setattr(ngram_join, "TOKEN_ENTRIES", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 30)
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(70)]
    rows = []
    for i in range(200):
        copy = list(words)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(copy)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_names_that_clash_and_long_texts(spark):
    """Columns named as the operator's own, doubled rows, and a text of a megabyte with its near copy."""
    long = " ".join(f"word{i * 7919 % 65521}" for i in range(100_000))
    rows = [(1, long), (2, long + " end"), (3, "other"), (3, "other"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["key", "cls", "comp", "id", "text_key", "row", "stays", "other_id", "other_key", "__key", "a.b"]
    wide = docs.selectExpr("*", *(f"doc_id as `{n}`" for n in names))
    kept = ngram_join.representatives(wide)
    assert kept.columns == wide.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, 4, None]
    assert joined(wide)[:2] == [(1, 65_521, 1, 1), (2, 65_522, 1, 1)]


def test_one_of_each_group_stays(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "doc_id as comp")
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = brute(rows)
    wordless = [g[0] for g in groups if g[1] == 0]
    assert sorted(ids, key=repr) == sorted([*{g[2] for g in groups if g[1]}, *wordless], key=repr)


def test_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_of_a_long_path(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    n = 200
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, "a", "b").collect()}
    assert got == dict.fromkeys(range(n), 0)
