"""WARC records in ZIP archives: a writer, and a reader that finds stored members by the directories and reads ranges.

An archive holds two stored members: archive/data.warc.gz, one gzip member per record, and indexes/index.cdx, a line per
record with its place. The reader parses the end record, the ZIP64 end record where there is one, and the central
directory; it then reads the index, and records by ranges of the archive file. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small_batches, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records after which a new archive begins; bytes read at once; ranges of a task; responses that are broadcast at most.
ARCHIVE_BYTES, RANGE_BYTES, RANGES_A_TASK, BROADCAST_ROWS = 256 << 20, 4 << 20, 8, 100_000

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _files(uri: str):
    """The file system of a path and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


# Writing


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with a WARC/1.1 response, or a revisit of refers_to that keeps the HTTP head and not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, records of each archive written to folder. pages: page_id, url, html, refers_to.

    A task that runs again writes archives of its own; only those of the run that counts are listed.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        at, lines, archive, member, name, stream = 0, [], None, None, "", None
        done: list[tuple[str, int]] = []

        def close() -> None:
            member.close()
            with archive.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                index.write("".join(lines).encode())
            archive.close()
            stream.close()
            done.append((f"{folder}/{name}", len(lines)))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or at >= archive_bytes:
                    if archive:
                        close()
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = files.open_output_stream(f"{root}/{name}")
                    archive, at, lines = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True), 0, []
                    member = archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                packed = record(page_id, url, (html or "").encode(), refers_to)
                member.write(packed)
                lines.append(f"{'-' if page_id is None else page_id} {at} {len(packed)}\n")
                at += len(packed)
        if archive:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(written, "path string, records long")


# Reading


class Member(NamedTuple):
    name: str
    offset: int
    size: int
    method: int


def directory(file: BinaryIO, size: int) -> list[Member]:
    """Members of a ZIP archive, each with the place of its data, by the end records and the central directory."""
    tail_at = max(0, size - (1 << 16) - 22)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, locator + 8)
        file.seek(end64)
        record64 = file.read(56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    file.seek(start)
    entries, at, out = file.read(length), 0, []
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", entries, at + 10)
        packed, plain, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", entries, at + 20)
        (header,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + name_size].decode()
        extra = entries[at + 46 + name_size : at + 46 + name_size + extra_size]
        packed, header = _zip64(extra, plain, packed, header)
        out.append((name, header, packed, method))
        at += 46 + name_size + extra_size + note_size
    members = []
    for name, header, packed, method in out:
        file.seek(header)
        local = file.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        members.append(Member(name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method))
    return members


def _zip64(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
    """Packed size and place of the local header, from the ZIP64 field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            if plain == 0xFFFFFFFF:
                next(values)
            packed = next(values) if packed == 0xFFFFFFFF else packed
            header = next(values) if header == 0xFFFFFFFF else header
            break
        at += 4 + size
    return packed, header


def ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, offset, length of runs of whole records, of about range_bytes, by each archive's index."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _files(path)
                size = files.get_file_info(at).size
                with files.open_input_file(at) as file:
                    members = {m.name: m for m in directory(file, size)}
                    data, index = members[DATA], members[INDEX]
                    if data.method or index.method:
                        raise ValueError(f"{path}: members must be stored")
                    file.seek(index.offset)
                    places = [tuple(map(int, line.split()[1:])) for line in file.read(index.size).decode().splitlines()]
                runs: list[list[int]] = []
                for offset, length in places:
                    if runs and runs[-1][1] + length <= range_bytes and runs[-1][0] + runs[-1][1] == data.offset + offset:
                        runs[-1][1] += length
                    else:
                        runs.append([data.offset + offset, length])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64())], names=["path", "offset", "length"])

    return archives.select("path").mapInArrow(found, "path string, offset long, length long")


class Record(NamedTuple):
    page_id: int | None
    kind: str
    digest: str
    refers_to: int | None
    payload_bytes: int
    payload: bytes | None


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse_records(data: bytes) -> Iterator[Record]:
    """Records of a run of gzip members. A response's digest and length are taken from its payload, and must agree with its head."""
    while data:
        unpack = zlib.decompressobj(31)
        plain = unpack.decompress(data) + unpack.flush()
        data = unpack.unused_data
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        yield Record(_page(fields["WARC-Record-ID"]), kind, digest, _page(fields.get("WARC-Refers-To")), size, payload if kind == "response" else None)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to[, payload] of every record of the archives (path)."""
    runs = staged(ranges(archives), "ranges")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                files, at = _files(path)
                with files.open_input_file(at) as file:
                    file.seek(offset)
                    found = list(parse_records(file.read(length)))
                columns = [pa.array([r.page_id for r in found], pa.int64()), pa.array([r.payload_bytes for r in found], pa.int64()), pa.array([r.digest for r in found], pa.string()), pa.array([r.kind for r in found], pa.string()), pa.array([r.refers_to for r in found], pa.int64())]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    columns, names = [*columns, pa.array([r.payload for r in found], pa.binary())], [*names, "payload"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = max(1, -(-runs.count() // RANGES_A_TASK))  # a count of one's own: by their bytes these rows would all go to one task
    return runs.repartition(parts, "path", "offset").mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of equal payloads of min_bytes and more, that with the largest page_id is
    kept and the others refer to it. Rows that repeat the kept page_id are kept too. A null page_id is less than all others."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    many = staged(keyed.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").select("digest", "kept"), "kept")
    small = many.count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(many) if small else many, "digest", "left")
    refers = F.when((F.col("size") >= min_bytes) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the shared folder and read every record back.

    A null html is empty, and its digest that of no bytes. A null page_id stays null; it is less than any other where the
    largest of equal payloads is sought. Rows that repeat the kept page_id are responses too, so that every row has its
    record. Payloads of any length are kept whole; other columns are not read; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(staged(write_archives(with_revisits(pages), folder), "archives"))
