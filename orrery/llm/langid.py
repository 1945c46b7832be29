"""Language ID by compression: the language whose zstandard raw-content dictionary encodes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

#: The bounded sample that is learned from: rows of a language, bytes of its dictionary, and of a piece where its rows hold more.
SAMPLE_DOCS, DICT_BYTES, PIECE = 256, 256 << 10, 512
#: A prediction is rejected if the runner-up is larger by less than this share of itself.
MIN_MARGIN = 0.01
#: Compression level, for texts of any length.
LEVEL = 11
#: Bytes that are encoded at a time, each with the dictionary alone, so that what it saves is the same share of a text of any length.
BLOCK = 16 << 10
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")

SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def held_out() -> F.Column:
    """True where crc32 of doc_id as text is divisible by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def language_dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content of each language in labelled (doc_id, text, lang), from SAMPLE_DOCS rows of it at most.

    The rows with the smallest hashes are taken, so the sample is the same whatever the order; what repeats does not crowd
    a language out. Of each, the whole text is read. Where they hold more than DICT_BYTES, pieces of PIECE bytes are drawn
    from all over them by hash. Rows without a language or a letter teach nothing.
    """
    known = labelled.where("lang is not null").where(F.col("text").rlike("\\p{L}"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return {}
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 40)).alias("h")
    hashed = known.select("lang", h, "text")

    def rows(share: dict[str, float]) -> dict[str, list[bytes]]:
        """Letters of the first rows by hash, of those below a share of all hashes."""
        least = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
        rank = Window.partitionBy("lang").orderBy("h", "text")
        drawn = hashed.where(F.col("h") < least * float(1 << 40)).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= SAMPLE_DOCS)
        found: dict[str, list[tuple[int, bytes]]] = {k: [] for k in share}
        for row in drawn.select("lang", "r", "text").toLocalIterator():
            found[row.lang].append((row.r, letters_only(row.text)))
        return {k: [t for _, t in sorted(v)] for k, v in found.items()}

    # some 8 * SAMPLE_DOCS rows of a language pass, so that ranking sees no more however many there are
    found = rows({k: min(1.0, 8 * SAMPLE_DOCS / n) for k, n in counts.items()})
    if few := {k: 1.0 for k, n in counts.items() if len(found[k]) < min(n, SAMPLE_DOCS)}:  # most of its rows repeat one another
        found |= rows(few)
    return {k: _dictionary(v) for k, v in sorted(found.items())}


def _dictionary(texts: list[bytes]) -> bytes:
    """texts, the first ones last, as the end of a dictionary is nearest to what it encodes; or pieces drawn from them."""
    if sum(map(len, texts)) + len(texts) <= DICT_BYTES:
        return b"\n".join(reversed(texts))
    pieces = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    drawn = sorted(range(len(pieces)), key=lambda i: xxhash.xxh3_64_intdigest(pieces[i], i))[: DICT_BYTES // (PIECE + 1)]
    return b"\n".join(pieces[i] for i in sorted(drawn, reverse=True))


def letters_only(text: str) -> bytes:
    """What is encoded: the text lower-cased, each run of other characters than letters as one space."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


class Scorer:
    """Encoded sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = list(dictionaries)
        self.encoders = []
        for content in dictionaries.values():
            shared = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.encoders.append(z.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected. `und`, and rejected, without a letter or without a language to choose."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0, True
        data = memoryview(letters_only(text))
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(e.compress(b)) for b in blocks), lang) for e, lang in zip(self.encoders, self.langs))
        best = sizes[0][0]
        other = sizes[1][0] if len(sizes) > 1 else max(best, len(data) + 9 * len(blocks))
        margin = 1 - best / other
        return sizes[0][1], other / (best + other), margin, margin < MIN_MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] = ()) -> DataFrame:
    """docs' doc_id and the columns in keep, with lang_pred, score, margin and rejected; text alone decides.

    Languages are as many as dictionaries. Null, empty or letterless texts are `und`, score 0, rejected. Equal sizes go to the language first in the alphabet,
    with margin 0, so rejected. Every row gives a row; whole texts are encoded, in blocks of BLOCK bytes.
    """
    small_batches(docs.sparkSession)
    kept = ["doc_id", *keep]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = ["lang_pred", "score", "margin", "rejected"]
    kind = "lang_pred string, score double, margin double, rejected boolean"
    text_at = len(kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [scorer(t.as_py()) for t in batch.column(text_at)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], *columns], names=[*kept, *names])

    read = docs.select(*kept, F.col("text").alias("text_read"))
    fields = ", ".join(f"`{c}` {t}" for c, t in read.dtypes[:-1])
    return read.mapInArrow(scored, f"{fields}, {kind}")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for each row of docs (doc_id, text, lang).

    Learns from the rows with a language that are not held out (see language_dictionaries), predicts from text alone.
    """
    learned = language_dictionaries(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return classify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def kept(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected: null, empty and letterless texts go, equal
    rows stay or go together, other columns may have any names, texts of any length are encoded whole."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    text_at = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not scorer(t.as_py())[3] for t in batch.column(text_at)], pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)
