import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orrery.llm import codes, pieces, whitening

# SentencePiece


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_slices_are_cut_at_chunks():
    rand = random.Random(3)
    for _ in range(500):
        text = "".join(rand.choice("▁▁ab") for _ in range(rand.randrange(40)))
        for size in (1, 2, 5, 100):
            assert [c for some in pieces.chunks(text, size) for c in some] == pieces.CHUNK.findall(text)
            assert "".join(c for some in pieces.chunks(text, size) for c in some) == text


@pytest.mark.parametrize("block", [2000, 32 << 20])
def test_against_the_library(spark, monkeypatch, block):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(pieces, "BLOCK_CHARS", block)
    rand, model = random.Random(7), SentencePieceProcessor(model_file=_model())
    odd = [None, "", " ", "  ", "▁", " \n ", "a", "a ", " a", "a▁b", "<s> </s> <unk> <0x0A>", "é é ﬁ　x", "🦜 ﻿\x00\x7f", "x" * 5000, "the " * 20_000, "漢字" * 3000]
    texts = odd + ["".join(rand.choice("ab ▁\n\t\x00é漢🦜<s>0x1  ") for _ in range(rand.randrange(60))) for _ in range(300)] + odd
    rows = [(None if i == 5 else i, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, block long")
    docs = docs.unionByName(docs.where("doc_id in (20, 21)"))
    got = pieces.encode(docs.repartition(3), _model())
    expected = {(i, tuple(model.encode(t or ""))) for i, t, *_ in rows}
    found = got.collect()
    assert len(found) == len(rows) + 2 and {(r.doc_id, tuple(r.tokens)) for r in found} == expected
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, _model()).collect()}
    assert digests == {(i, len(t), hashlib.sha256(",".join(map(str, t)).encode()).hexdigest(), hashlib.sha256(model.decode(list(t)).encode()).hexdigest()) for i, t in expected}


def test_decoding_of_any_ids(spark):
    from sentencepiece import SentencePieceProcessor

    model, rand = SentencePieceProcessor(model_file=_model()), random.Random(1)
    rows = [(i, [rand.randrange(300) if i % 2 else rand.randrange(32000) for _ in range(i)]) for i in range(40)] + [(99, None)]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, tokens array<int>").withColumn("text", F.lit("old")), _model())
    assert {(r.doc_id, r.text) for r in got.collect()} == {(i, model.decode(t) if t is not None else "") for i, t in rows}


def test_each_distinct_chunk_is_segmented_once(spark):
    docs = spark.createDataFrame([(i, "the cat the dog " * 5 + str(i % 3)) for i in range(60)], "doc_id long, text string").repartition(6)
    held = pieces.blocks(docs, _model(), 4).persist()
    assert held.count() == 6
    lists = held.select("block", F.explode("lists").alias("l")).select("block", "l.list").collect()
    assert len({r.list for r in lists}) <= 4 and all(len({r.list for r in lists if r.block == b}) == sum(r.block == b for r in lists) for b in {r.block for r in lists})
    plan = pieces.encode(docs, _model())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # lists to their tasks, ids back to the blocks; documents stay


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(none, _model()).collect() == [] and pieces.round_trip(none, _model()).collect() == []
    assert [r.tokens for r in pieces.encode(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), _model()).collect()] == [[], []]


# Whitening


def _brute(x: np.ndarray, k: int):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], (x - s / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "label": F.lit(None).cast("string"), "n": F.lit(1)})


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_whitening_against_eigh(spark, size):
    rand = np.random.default_rng(2)
    good = rand.standard_normal((120, 20)) * np.linspace(1, 3, 20) * size
    rows = [(i, r.tolist()) for i, r in enumerate(good)] + [(500 + i, good[0].tolist()) for i in range(40)] + [(3, good[3].tolist()), (None, good[5].tolist())]
    bad = [(900, None), (901, [None] * 20), (902, [float("nan")] + [0.0] * 19), (903, [float("inf")] + [0.0] * 19), (904, [1.0] * 19 + [float("-inf")])]
    got = whitening.whiten(_vectors(spark, rows + bad).repartition(3)).toPandas()
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64).astype(object if size > 1 else np.int64)
    n, far, white, share = _brute(np.array(x, float) if size > 1 else x, 4)
    assert len(got) == 4 * len(rows) and set(got.n) == {120} == {n} and got.identity_error.max() < 1e-10
    whole = np.unique(np.array(x, float), axis=0)
    exact = {tuple(r): sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, [sum(int(v) for v in c) for c in whole.T])) for r in map(tuple, np.array(x, float))}
    place = {(i, tuple(np.array(v, float))): k for k, ((i, _), v) in enumerate(zip(rows, x))}
    for i in (0, 3, 17, 119, 500):
        mine = got[got.vec_id == i].drop_duplicates().sort_values("component")
        k = next(v for (j, _), v in place.items() if j == i)
        assert {int(d) for d in mine.deviation} == {exact[tuple(np.array(x[k], float))]}
        assert np.allclose(np.abs(mine.whitened.values[:4]), np.abs(white[k]), rtol=1e-7, atol=1e-8) and np.allclose(sorted(set(mine.explained), reverse=True), share, rtol=1e-9)
    signs = np.sign(got[got.vec_id == 0].sort_values("component").whitened.values * white[0])
    for i in (1, 60, 110):
        assert np.allclose(got[got.vec_id == i].sort_values("component").whitened.values * signs, white[i], rtol=1e-6, atol=1e-7)


def test_few_and_flat_vectors(spark):
    assert whitening.whiten(_vectors(spark, [])).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])] * 5 + [(2, None)])).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, []), (2, [])])).collect() == []
    two = whitening.whiten(_vectors(spark, [(1, [0.0, 0.0, 1.0]), (2, [1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, round(r.whitened, 9), round(r.explained, 9)) for r in two) == [(1, 1, 2, -1.0, 1.0), (2, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
    with pytest.raises(ValueError):
        whitening.whiten(_vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_lanczos_restarts_and_breaks_down():
    rand = np.random.default_rng(5)
    q, _ = np.linalg.qr(rand.standard_normal((300, 300)))
    for values in (np.linspace(1, 0.01, 300), np.r_[9, 9, 9, 5, np.ones(296)], np.r_[4, 3, 2, 1, np.zeros(296)], np.full(300, 7.0), 0.97 ** np.arange(300)):
        a = (q * values) @ q.T
        calls = []

        def product(b, a=a, calls=calls):
            calls.append(b.shape[1])
            return a @ b

        e, u = whitening.block_lanczos(product, 300, 4, block=3, most=40)
        assert np.allclose(e, values[:4], rtol=1e-10) and np.allclose(a @ u, u * e, atol=1e-8) and np.allclose(u.T @ u, np.eye(4), atol=1e-9)
        assert max(calls) <= 3
    # the first block lies in an invariant subspace that lacks the largest value
    start = np.random.default_rng(0).standard_normal((6, 2))
    basis, _ = np.linalg.qr(np.hstack([start, rand.standard_normal((6, 4))]))
    a = (basis * [2, 1, 9, 8, 0, 0]) @ basis.T
    e, _ = whitening.block_lanczos(lambda b: a @ b, 6, 4, block=2)
    assert np.allclose(e, [9, 8, 2, 1])


# Vector codes


def _plain(rows, parts=16, entries=64, rounds=2):
    """Whole rounds in Python integers: vec_id -> [(code, error)], and the codebooks."""
    from math import floor

    kept = [(i, label, [floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    width = len(kept[0][2]) // parts
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def near(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        have = [[[] for _ in first] for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                have[p][near(p, x)[0]].append(x)
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else books[p][e] for e, h in enumerate(have[p])] for p in range(parts)]
    out = []
    for i, label, v in kept:
        found = [near(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, label, bytes(f[0] for f in found).hex(), sum(f[1] for f in found)))
    return out, books


@pytest.mark.parametrize("size", [1.0, 3e7, 1e13])
def test_codes_against_plain_rounds(spark, size):
    rand = np.random.default_rng(11)
    good = np.round(rand.standard_normal((150, 32)), 2) * size
    rows = [(i // 2 if i < 20 else i, None if i % 3 == 0 else i % 2, v.tolist()) for i, v in enumerate(good)] + [(700, 1, good[7].tolist())] * 3 + [(None, 1, good[9].tolist())]
    bad = [(-5, 1, None), (-4, 1, [None] * 32), (-3, None, [float("nan")] * 32), (-2, 1, [float("inf")] * 32)]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>").withColumns({"code": F.lit("clash"), "v": F.lit(1), "error": F.lit(None).cast("int")})
    coded, books = codes.compress(df.repartition(5))
    expected, plain = _plain(rows + bad)
    assert [[[int(x) for x in e] for e in b] for b in books] == plain
    total = {k: sum(e for _, label, _, e in expected if label == k) for k in (None, 0, 1)}
    got = sorted(((r.vec_id, r.label, bytes(r.code).hex(), int(r.error), int(r.label_error)) for r in codes.with_label_error(coded).collect()), key=repr)
    assert got == sorted(((i, label, c, e, total[label]) for i, label, c, e in expected), key=repr)


def test_changes_keep_sums_up():
    rand = np.random.default_rng(4)
    x, old = rand.integers(-99, 99, (500, 32)), rand.integers(0, 8, (500, 16)).astype(np.uint8)
    new = np.where(rand.random((500, 16)) < 0.1, rand.integers(0, 8, (500, 16)), old).astype(np.uint8)
    whole = codes.changes(x, None, old, 8)
    moved = codes.changes(x, old, new, 8)
    after = codes.changes(x, None, new, 8)
    assert all((a + b == c).all() for a, b, c in zip(whole, moved, after)) and not any(c.any() for c in codes.changes(x, new, new, 8))


def test_only_changed_parts_are_summed(spark):
    v, code = list(range(32)), bytes(16)
    rows = [(v, code, code), (v, bytes([1] + [0] * 15), code)]
    sums, counts = codes._changed(spark.createDataFrame(rows, "v array<long>, code binary, was binary"), (16, 4, 2))
    assert counts == {0: -1, 1: 1} and sums == {(0, 0): 0, (0, 1): -1, (1, 0): 0, (1, 1): 1}


def test_few_vectors_and_labels(spark, monkeypatch):
    kind = "vec_id long, label int, embedding array<float>"
    none, books = codes.compress(spark.createDataFrame([], kind))
    assert none.collect() == [] and books is None
    assert codes.compress(spark.createDataFrame([(1, 1, None)], kind))[1] is None
    three = [(5, 1, [0.5] * 16), (5, 1, [0.25] * 16), (2, None, [0.5] * 16)]
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    coded, books = codes.compress(spark.createDataFrame(three, kind))
    assert [[e[0] for e in b] for b in books.tolist()] == [[128, 64, 128]] * 16
    assert sorted((r.vec_id, bytes(r.code)[0], int(r.error), int(r.label_error)) for r in codes.with_label_error(coded).collect()) == [(2, 0, 0, 0), (5, 0, 0, 0), (5, 1, 0, 0)]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, 1, [1.0] * 17)], kind))


def test_queries_of_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for q in ("op11_sentencepiece", "op12_whitening", "op13_vector_codes"):
        assert entry.queries()[q](spark, str(tmp_path)).collect() == []
