"""SentencePiece encoding by a table of distinct chunks, and decoding.

Where no piece of a model holds the white-space marker behind another character, no merge reaches over the start of a run of
markers. A normalised text so falls into chunks, a run of markers and what follows up to the next run, whose ids are those of
the text, one chunk after the other.

Documents are gathered in blocks. A block keeps of each document the numbers of its chunks, and each chunk once, dealt by hash
into lists. The lists of one hash from all blocks meet in one task, where each distinct chunk of the corpus is segmented once;
what goes back to a block are the ids of its chunks in the order of their numbers, and documents are read off by position.
Blocks lie in a table that is bucketed by block, so documents themselves are never shuffled.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small_batches

MARK = "▁"
#: A run of markers with what follows it, or what stands before the first one.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters of a block (a longer text is a block alone), of a slice of a text that is cut into chunks at once, and of the
#: corpus for each list that chunks are dealt into: a task holds a list's distinct chunks, at most so many characters.
BLOCK_CHARS, SLICE_CHARS, LIST_CHARS = 16 << 20, 1 << 20, 64 << 20
#: Spark's own bound on buckets of a table; documents whose ids are read off together.
MAX_BUCKETS, SOME_DOCS = 100_000, 256

BLOCK_SCHEMA = "block long, doc_ids array<long>, sizes array<long>, codes binary, lists array<struct<list:int, chunks:binary>>"
LIST_SCHEMA = "block long, list int, sizes binary, ids binary"
TOKENS_SCHEMA = "doc_id long, tokens array<int>"


class Segmenter:
    """Ids of chunks by a model; an error if the model's pieces could cross from one chunk into the next."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        self.normalize = m.normalize
        if any(MARK in p.lstrip(MARK) for p in map(m.id_to_piece, range(m.vocab_size()))):
            raise ValueError("the model has pieces that cross a white-space marker")
        self.alone = m.piece_to_id(MARK)
        if m.is_unknown(self.alone):
            raise ValueError("the model does not know the white-space marker")
        self.prefixed = m.normalize("a") == MARK + "a"

    def __call__(self, chunk: str) -> list[int]:
        if chunk == MARK:  # the library gives no ids to an empty text
            return [self.alone]
        bare = chunk[1:] if self.prefixed else chunk
        if self.normalize(bare) != chunk:
            raise ValueError(f"the model's normaliser does not keep the chunk {chunk!r}")
        return self.model.encode(bare, add_bos=False, add_eos=False, enable_sampling=False)


#: One model a worker.
_KEPT: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    if path not in _KEPT:
        _KEPT[path] = Segmenter(path)
    return _KEPT[path]


def chunks(text: str, size: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Chunks of a normalised text, slice by slice; a slice ends where a run of markers starts."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            while end < len(text) and not (text[end] == MARK and text[end - 1] != MARK):
                # to the next marker whose left neighbour is none
                end = text.find(MARK, end + 1) if text[end] != MARK else end + 1
                if end < 0:
                    end = len(text)
        yield CHUNK.findall(text[at:end])
        at = end


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of their places."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Block:
    """Documents of a block: numbers of their chunks, and the chunks by number."""

    def __init__(self, number: int):
        self.number, self.code, self.doc_ids, self.sizes, self.codes, self.chars = number, {}, [], [], array("I"), 0

    def add(self, doc_id: int | None, text: str) -> None:
        code, before = self.code, len(self.codes)
        for some in chunks(text):
            self.codes.extend([code.setdefault(c, len(code)) for c in some])
        self.doc_ids.append(doc_id)
        self.sizes.append(len(self.codes) - before)
        self.chars += len(text)

    def row(self, lists: int) -> pa.RecordBatch:
        """The block with its chunks dealt into lists, and numbered anew in the order of the lists."""
        import zstandard

        dealt: dict[int, list[str]] = {}
        for c in self.code:
            dealt.setdefault(zlib.crc32(c.encode()) % lists, []).append(c)
        order = np.zeros(len(self.code), np.uint32)
        z, held, n = zstandard.ZstdCompressor(level=3), [], 0
        for k in sorted(dealt):
            some = sorted(dealt[k])
            for i, c in enumerate(some, n):
                order[self.code[c]] = i
            n += len(some)
            held.append({"list": k, "chunks": z.compress(json.dumps(some, ensure_ascii=False).encode())})
        codes = _packed(order[np.frombuffer(self.codes, np.uint32)] if len(self.codes) else np.zeros(0, np.uint32))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([("list", pa.int32()), ("chunks", pa.binary())]))]
        values = [self.number, self.doc_ids, self.sizes, codes, held]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "doc_ids", "sizes", "codes", "lists"])


def blocks(docs: DataFrame, model: str, lists: int) -> DataFrame:
    """Blocks of documents (doc_id, text); a null text is empty."""
    most = BLOCK_CHARS

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalize, first = segmenter(model).normalize, TaskContext.get().partitionId() << 32
        block = _Block(first)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = normalize(text.as_py() or "")
                if block.chars and block.chars + len(text) > most:
                    yield block.row(lists)
                    block = _Block(block.number + 1)
                block.add(doc_id, text)
        if block.doc_ids:
            yield block.row(lists)

    return docs.select("doc_id", "text").mapInArrow(made, BLOCK_SCHEMA)


def segmented(held: DataFrame, model: str) -> DataFrame:
    """block, list, and how many ids each chunk of the list has in the block, and these. Of one list's chunks, which come from
    all blocks one after the other, each distinct one is segmented once."""
    dealt = held.select("block", F.explode("lists").alias("l")).select("block", "l.list", "l.chunks").repartition("list").sortWithinPartitions("list")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ids_of, z, at, table = segmenter(model), zstandard.ZstdDecompressor(), None, {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for block, number, data in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at:
                    at, table = number, {}
                sizes, ids = array("I"), array("I")
                for chunk in json.loads(z.decompress(data)):
                    found = table.get(chunk)
                    if found is None:
                        found = table[chunk] = array("I", ids_of(chunk))
                    sizes.append(len(found))
                    ids.extend(found)
                for column, value in zip(out, (block, number, _packed(np.frombuffer(sizes, np.uint32)), _packed(np.frombuffer(ids, np.uint32)))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "list", "sizes", "ids"])

    return dealt.mapInArrow(encoded, LIST_SCHEMA)


def _tokens(own: pa.Table, lists: pa.Table) -> pa.Table:
    """doc_id, tokens of one block's documents: ids of its chunks, read off by position."""
    lists = lists.sort_by("list")
    none = np.zeros(0, np.uint32)
    size = np.concatenate([none, *map(_unpacked, lists["sizes"].to_pylist())]).astype(np.int64)
    ids = np.concatenate([none, *map(_unpacked, lists["ids"].to_pylist())]).astype(np.int32)
    start = np.cumsum(size) - size
    codes = _unpacked(own["codes"][0].as_py())
    doc_ids, sizes = pa.array(own["doc_ids"][0].as_py(), pa.int64()), np.array(own["sizes"][0].as_py(), np.int64)
    borders = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for at in range(0, len(doc_ids), SOME_DOCS):
        ends = borders[at : at + SOME_DOCS + 1]
        some = codes[ends[0] : ends[-1]]
        lengths = size[some]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        flat = ids[np.repeat(start[some] - stops[:-1], lengths) + np.arange(stops[-1])]
        tokens = pa.ListArray.from_arrays(pa.array(stops[ends - ends[0]], pa.int32()), pa.array(flat, pa.int32()))
        out.append(pa.RecordBatch.from_arrays([doc_ids[at : at + SOME_DOCS], tokens], names=["doc_id", "tokens"]))
    return pa.Table.from_batches(out)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, tokens of each row of docs (doc_id, text): the ids that the sentencepiece library gives the whole text with this
    model file, without begin and end ids and without sampling.

    A null text is empty and has no ids, as has an empty one; a null doc_id stays null; repeated rows are encoded each; texts
    of any length are read whole. An empty table gives no rows. Other columns are not read. A model whose pieces can cross a
    white-space marker, or whose normaliser changes its own output, is an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_BUCKETS, max(shuffled, -(-chars // BLOCK_CHARS)))
    name = f"chunk_blocks_{uuid.uuid4().hex[:12]}"
    made = blocks(docs, model, max(shuffled, -(-chars // LIST_CHARS)))
    made.write.option("path", new_path(spark, "chunks")).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    held = spark.table(name)
    own = held.select("block", "doc_ids", "sizes", "codes")
    return own.groupBy("block").cogroup(segmented(held, model).groupBy("block")).applyInArrow(_tokens, TOKENS_SCHEMA)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (tokens, ...) with text: what the library decodes each row's whole ids to; null ids give an empty text, and no
    column of encoded but `text` is changed."""
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*kept).schema.add("text", "string")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = segmenter(model).model.decode
        at = kept.index("tokens")
        for batch in batches:
            texts = [text_of(ids.values.to_pylist()) if ids.is_valid else "" for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return encoded.select(*kept).mapInArrow(decoded, schema)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: documents encoded and decoded again; digests are of the decimal ids joined
    by commas, and of the decoded text. Odd rows are treated as encode() does."""
    both = decode(encode(docs, model), model)
    joined = F.concat_ws(",", F.col("tokens").cast("array<string>"))
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
