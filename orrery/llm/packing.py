"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Tokens of a sequence; the id that ends each document; documents of a group, on average.
MAX_TOKENS, END_ID, GROUP_DOCS = 4096, 2, 8192
#: Entries after which a worker's table of encoded words forgets the older half.
CACHE_WORDS = 300_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


class WordIds(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes, by the tokenizer of a word-level BPE file.

    The file's tokenizer lower-cases, parts text by a fixed pattern and encodes each part alone, so a text's ids are
    those of its parts in turn. Where all characters are Latin-1 the pattern is applied here and each distinct part
    goes to the tokenizer's BPE model once; any other text takes the tokenizer's own path, by white-space chunks.
    """

    # The file's pre-tokenizer pattern with its classes spelt out for lower-cased Latin-1.
    L, N, S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc\xbd\xbe", "\t-\r \x85\xa0"
    PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+")

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit // 2, {}
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.keep(part, found)
        return found

    def keep(self, part: str, found: bytes) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[part] = found

    def chunk(self, chunk: str) -> bytes:
        """Any chunk between white space, kept under a key that no part has."""
        key = " " + chunk
        found = self.get(key) or self.older.get(key)
        if found is None:
            found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self.keep(key, found)
        return found

    def text(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = "<|" not in text and not any(c in text for c in _CONTROLS)
        if plain:
            return b"".join(map(self.__getitem__, self.PART.findall(text.lower())))
        return b"".join(map(self.chunk, filter(None, re.split(r"[ \t\n\r\x0b\x0c]+", text))))


#: White space to str.split and friends, but not to the tokenizer: such text takes the tokenizer's own path.
_CONTROLS = "\x1c\x1d\x1e\x1f"


#: One table of words a worker, whatever number of tasks it runs.
_KEPT: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


def tokenized_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most max_tokens ids: doc_id, start, length, ids_crc32, doc_tokens, grp (a 64-bit random group key of the document), and ids if asked for.

    A null text is an empty one: its document is the end id alone. Repeated rows are documents of their own.
    """
    small_batches(docs.sparkSession)
    kind = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("grp", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step, end = _encoder(tokenizer), 4 * max_tokens, struct.pack("<I", end_id)
        seen: dict[tuple, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.text(text.as_py() or "") + end
                same = (doc, len(ids), zlib.crc32(ids))
                seen[same] = again = seen.get(same, -1) + 1
                group = _mixed(*same, again)
                if len(seen) > 200_000:
                    seen.clear()
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row = [doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, group]
                    for column, value in zip(out, row + [np.frombuffer(part, "<u4").astype(np.int32)] * with_ids):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE_SCHEMA + ", grp long" + ", ids array<int>" * with_ids)


def _mixed(doc: int | None, size: int, crc: int, again: int) -> int:
    """A signed 64-bit key that follows from the document and from how many equal rows came before, so that a task that
    runs again deals alike and repeated rows spread out."""
    x = ((doc or 0) * 0x9E3779B97F4A7C15 ^ size << 40 ^ crc << 8 ^ again * 0xD6E8FEB86659FD93) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return (x ^ x >> 31) - (1 << 63)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: the longest first, each into the first bin with room.

    A tournament tree holds at each node the largest room of the bins below, so the first bin with room is found by
    going down from the root, left where the left half has enough. There are never more bins than items.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, int(n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, max_tokens: int = MAX_TOKENS, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces with sequence_id and offset. Groups are random, hold group_docs whole documents on average and are packed alone.

    A piece of max_tokens fills a sequence of its own. sequence_id is the group's number times 2**32 plus the bin's.
    """
    groups = max(1, -(-n_docs // group_docs))
    dealt = pieces.withColumn("grp", F.pmod("grp", F.lit(groups)))

    def packed(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("grp").sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "ids_crc32"))])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), max_tokens)
        ids = (key[0].as_py() << 32) + bins
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    extra = ", ids array<int>" if "ids" in pieces.columns else ""
    return dealt.groupBy("grp").applyInArrow(packed, PIECE_SCHEMA + extra + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """Cut documents (doc_id, text, ...) into pieces of at most max_tokens ids and pack them, first-fit decreasing.

    Result: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset. Nulls: a null text is empty, a null
    doc_id stays null. An empty table gives no rows. Repeated rows are packed each. Other columns are not read.
    """
    return pack(tokenized_pieces(docs, tokenizer, max_tokens, end_id, with_ids), docs.count(), max_tokens, group_docs)
