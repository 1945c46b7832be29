"""Quality by weak labels: expectation-maximisation over heuristic labellers, and a hashed linear scorer of its posteriors.

Each labeller votes good (1), bad (-1) or not at all (0) on a document. How often each combination of votes occurs is
counted over all documents; EM finds the labellers' accuracies, and with them each combination's probability of being good. The scorer
learns these probabilities from a bounded sample of documents, and scores every document by its words and their shapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, small_batches, staged

#: Documents that the scorer is fitted on at most, about; hashed features; passes of EM; steps of the fit; words that a worker remembers.
SAMPLE_DOCS, FEATURES, EM_PASSES, STEPS, CACHE_WORDS = 4000, 1 << 15, 100, 150, 150_000
KEEP_FROM = 0.5

LABELLERS = ("symbols", "capitals", "separators", "repetition", "variety", "plain_words", "word_length", "letters")

_DROP_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DROP_SYMBOLS = b"#$%&*@^~<>\\{}=+"
_UPPER = bytes(range(65, 91))


def votes(text: str | None) -> tuple[int, ...]:
    """Each labeller's vote on a text. Without words, all but the last abstain."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw) - len(words))
    if not n:
        return (0,) * (len(LABELLERS) - 1) + (-1,)
    symbols = (len(raw) - len(raw.translate(None, _DROP_SYMBOLS))) / size
    plain = len(raw.translate(None, _DROP_LETTERS))
    letters = (len(raw) - plain) / size
    capitals = (len(raw) - len(raw.translate(None, _UPPER))) / max(1, len(raw) - plain)
    separators = sum(map(raw.count, (b"|", b"\t", b"!!", b"??"))) / n
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n if n > 1 else 0.0
    variety = len(set(words)) / n**0.75
    plain_words = sum(len(w) <= 4 and w.isalpha() and w.islower() for w in words) / n
    mean = size / n

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else int(good)

    return (
        vote(symbols > 0.1, symbols < 0.02),
        vote(capitals > 0.4, capitals < 0.15),
        vote(separators > 0.2, separators < 0.02),
        vote(repeated > 0.3, n > 4 and repeated < 0.05),
        vote(n > 20 and variety < 0.5, n > 20 and variety > 1),
        vote(n > 20 and plain_words < 0.08, plain_words > 0.2),
        vote(mean > 12 or mean < 2.5, 3 < mean < 9),
        vote(letters < 0.6, letters > 0.85),
    )


#: How often a labeller is expected to vote bad, where it votes, on a bad and on a good document, and what share of all documents this counts for as evidence.
EXPECTED, STRENGTH = (0.3, 0.005), 0.1


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, passes: int = EM_PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern of votes being good, the labellers' chances of voting bad given bad and given good, and the prior.

    Labellers are taken as independent given the class; not to vote says nothing. EM starts from one bad vote outweighing
    four good ones, as each labeller looks for one kind of defect, and weighs what it counts with EXPECTED chances, so
    that a rare defect is not taken for a whim of its labeller.
    """
    bad_vote, good_vote = (patterns < 0).astype(float), (patterns > 0).astype(float)
    good = 1 / (1 + np.exp(4 * bad_vote.sum(axis=1) - good_vote.sum(axis=1)))
    chances, prior = np.zeros((2, patterns.shape[1])), 0.5
    mass = STRENGTH * counts.sum() + 1
    for _ in range(passes):
        for c, p in enumerate((1 - good, good)):
            bad = ((counts * p)[:, None] * bad_vote).sum(axis=0) + mass * EXPECTED[c]
            chances[c] = bad / (bad + ((counts * p)[:, None] * good_vote).sum(axis=0) + mass * (1 - EXPECTED[c]))
        prior = float(np.clip((counts * good).sum() / counts.sum(), 0.02, 0.98))
        logs = bad_vote @ np.log(chances).T + good_vote @ np.log(1 - chances).T
        after = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + logs[:, 0] - np.log(prior) - logs[:, 1], -50, 50)))
        done = np.abs(after - good).max() < 1e-9
        good = after
        if done:
            break
    return good, chances, prior


class WordFeatures(dict):
    """Word -> positions of its two features: itself, lower-cased, and its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = re.sub(rb"[a-z\x80-\xff]+", b"x", re.sub(rb"[A-Z]+", b"X", re.sub(rb"[0-9]+", b"0", word)))[:8]
        found = (xxhash.xxh3_64_intdigest(b"w" + word.lower()) % FEATURES, xxhash.xxh3_64_intdigest(b"s" + shape) % FEATURES)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


_FEATURES = WordFeatures()
_REPEAT = xxhash.xxh3_64_intdigest(b"repeat") % FEATURES


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values: shares of the text's words and shapes, and of words that repeat the one before."""
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.fromiter((x for p in map(_FEATURES.__getitem__, words) for x in p), np.int64, 2 * n)
    at, counts = np.unique(pairs, return_counts=True)
    values = counts / n
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    return np.append(at, _REPEAT), np.append(values, repeated)


def fit(rows: list[tuple[np.ndarray, np.ndarray, float, float]], steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of soft labels: (positions, values, label, weight) of each document."""
    weights, intercept = np.zeros(FEATURES), 0.0
    if not rows:
        return weights, intercept
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    label, mass = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    mass = mass / mass.sum()
    squares, square = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(steps):
        score = np.bincount(row, value * weights[at], len(rows)) + intercept
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - label) * mass
        gradient = np.bincount(at, value * error[row], FEATURES) + 1e-6 * weights
        squares += gradient**2
        square += error.sum() ** 2
        weights -= 1.0 * gradient / np.sqrt(squares)
        intercept -= 0.5 * error.sum() / np.sqrt(square)
    return weights, intercept


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, pattern (the votes as digits 0 to 2), h (hash of the row)."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = ["".join(str(v + 1) for v in votes(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.string())], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(voted, "doc_id long, pattern string")


def posteriors(counts: dict[str, int]) -> dict[str, float]:
    """Pattern -> probability of being good."""
    if not counts:
        return {}
    names = sorted(counts)
    patterns = np.array([[int(c) - 1 for c in n] for n in names])
    good, _, _ = expectation_maximisation(patterns, np.array([counts[n] for n in names], float))
    return dict(zip(names, good.tolist()))


def classify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, score, posterior, votes, keep for each row of docs (doc_id, text).

    score is the linear scorer's chance of good quality, posterior that of the document's votes alone, keep whether score
    is keep_from or more. votes has a digit per labeller: 0 bad, 1 none, 2 good. Null and empty texts have no features:
    their score is their posterior. Votes are counted over all rows, repeated ones each; an empty table gives no rows.
    Equal texts score alike; texts of any length are read whole; other columns are not read. The scorer is fitted on some
    sample_docs rows, those with the smallest hashes of doc_id and text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    voted = staged(labelled(docs), "votes")
    counts = {r.pattern: r["count"] for r in voted.groupBy("pattern").count().collect()}  # 3 ** labellers at most
    discard(voted)
    good = posteriors(counts)
    total = sum(counts.values())
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit("quality")), F.lit(1 << 30))
    share = min(1.0, sample_docs / max(1, total))
    drawn = docs.where(h < int((1 << 30) * share))
    if share < 1 and len(drawn.select("doc_id").take(sample_docs // 4)) < sample_docs // 4:  # most rows repeat one another
        drawn = docs.orderBy(h).limit(sample_docs)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*features(t.as_py()), good["".join(str(v + 1) for v in votes(t.as_py()))]) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())), pa.array([f[2] for f in found], pa.float64())], names=["at", "value", "label"])

    rows = drawn.select("text").mapInArrow(sampled, "at array<int>, value array<float>, label double").toLocalIterator()
    taken = [(np.array(r["at"], np.int64), np.array(r["value"]), r["label"]) for r, _ in zip(rows, range(4 * sample_docs)) if r["at"]]
    share = np.clip(sum(t[2] for t in taken) / max(1, len(taken)), 0.02, 0.98)
    weights, intercept = fit([(*t, 0.5 * (t[2] / share + (1 - t[2]) / (1 - share))) for t in taken])
    shared = spark.sparkContext.broadcast((weights, intercept, good))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept, good = shared.value
        for batch in batches:
            patterns, posterior, scores = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                at, value = features(text)
                patterns.append("".join(str(v + 1) for v in votes(text)))
                posterior.append(good[patterns[-1]])
                scores.append(1 / (1 + np.exp(-np.clip(weights[at] @ value + intercept, -50, 50))) if len(at) else posterior[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(posterior, pa.float64()), pa.array(patterns, pa.string()), pa.array([s >= keep_from for s in scores], pa.bool_())], names=["doc_id", "score", "posterior", "votes", "keep"])

    return docs.mapInArrow(scored, "doc_id long, score double, posterior double, votes string, keep boolean")
