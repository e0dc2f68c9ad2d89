"""Media columns: byte payloads as 8-bit greyscale PNG images in archives, and a data source that reads them back.

An archive is a sequence of stored members followed by its directory (name, offset, length, crc of each) and a
fixed-size tail that tells where the directory is. The data source plans byte ranges from a manifest that tells where
each archive's directory begins (for a folder without one, from the archives' tails); each task finds its range's members in the directory, streams them in Arrow batches and reads a
member that fails again by its own offset, a few times, so one bad read doesn't repeat the range.

Null payloads are written as empty ones (64 zero bytes after padding); names may repeat and may be null; an empty
table gives no archive and no rows; repeated rows are members each. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarisk.llm.common import filesystem, mapped, new_folder, reader, stored_map, whole_text, writer

WIDTH = 64
ARCHIVE_BYTES = 1024 * 1024 * 1024
RANGE_BYTES = 16 * 1024 * 1024
#: So many ranges at most are planned; of more bytes than that each range gets larger.
MOST_RANGES = 100_000
BATCH_BYTES = 4 * 1024 * 1024
RETRIES = 3
PNG, LENGTH = b"\x89PNG\r\n\x1a\n", b"tmLn"
#: has a name, name, offset, length, crc32
ENTRY = struct.Struct("<BqQQI")
#: Entries of a directory that are read at a time.
ENTRY_BLOCK = 1024
#: directory offset, entries, magic
TAIL = struct.Struct("<QQ8s")
MAGIC = b"TMRKARC1"
MEMBERS = "name long, offset long, media binary"


def padded(payload: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of the image width."""
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, length: int) -> bytes:
    """An image of ``WIDTH`` columns, one sample a byte; a private chunk keeps the length before padding."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(LENGTH, struct.pack(">Q", length)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 5)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows, columns) of an 8-bit greyscale image with any of the five row filters, and the kept length."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, body, size, length = 8, [], (0, 0), -1
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
            size = (h, w)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == LENGTH:
            length = struct.unpack(">Q", part)[0]
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[0], size[1] + 1)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    for y in np.flatnonzero(kinds):
        up = out[y - 1].astype(int) if y else np.zeros(size[1], int)
        if kinds[y] == 2:
            out[y] = (out[y] + up) & 255
            continue
        row, left, corner = out[y].astype(int), 0, 0
        for x in range(size[1]):
            if kinds[y] == 1:
                guess = left
            elif kinds[y] == 3:
                guess = (left + up[x]) // 2
            else:
                p = left + up[x] - corner
                guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
            left, corner = (row[x] + guess) & 255, up[x]
            row[x] = left
        out[y] = row
    return out, length if length >= 0 else out.size


def features(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, and a 64-bit hash of which of 8 x 8 areas are brighter than their mean."""
    rows = np.array_split(samples, 8) if len(samples) >= 8 else [samples[i * len(samples) // 8 : i * len(samples) // 8 + 1] for i in range(8)]
    areas = np.stack([r.reshape(len(r), 8, WIDTH // 8).sum(axis=(0, 2), dtype=np.int64) / (len(r) * WIDTH // 8) for r in rows])
    bits = np.packbits((areas > areas.mean()).ravel()).tobytes().hex()
    return f"{samples.mean():.3f}:{samples.std():.3f}:{bits}"


class ArchiveWriter:
    def __init__(self, out) -> None:
        self.out, self.at, self.entries = out, 0, []

    def add(self, name: int | None, media: bytes) -> None:
        self.entries.append((name, self.at, len(media), zlib.crc32(media)))
        self.out.write(media)
        self.at += len(media)

    def close(self) -> None:
        for name, at, n, crc in self.entries:
            self.out.write(ENTRY.pack(name is not None, name or 0, at, n, crc))
        self.out.write(TAIL.pack(self.at, len(self.entries), MAGIC))


def tail(f) -> tuple[int, int]:
    """Where an archive's directory begins, and its number of entries."""
    end = f.seek(0, 2)
    f.seek(end - TAIL.size)
    at, n, magic = TAIL.unpack(f.read(TAIL.size))
    if magic != MAGIC:
        raise ValueError("not an archive")
    return at, n


def write_archives(payloads: DataFrame, name: str, payload: str, folder: str) -> DataFrame:
    """Each partition's payloads (a binary column) as archives of a bounded size; ``path, members, directory`` (its place) of each.

    A task that runs again writes new files; only those that are returned count.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, opened, w, path = [], None, None, ""

        def close() -> None:
            w.close()
            opened.__exit__(None, None, None)
            made.append((path, len(w.entries), w.at))

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if w is None:
                    path = f"{folder}/{uuid.uuid4().hex}.arc"
                    opened = writer(path)
                    w = ArchiveWriter(opened.__enter__())
                raw = body.as_py()
                w.add(key, encode_png(padded(raw), len(raw)))
                if w.at >= ARCHIVE_BYTES:
                    close()
                    w = None
        if w is not None:
            close()
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], ["path", "members", "directory"])

    rows = payloads.select(F.col(name).cast("long").alias("name"), F.coalesce(F.col(payload), F.lit(b"")).alias("payload"))
    return stored_map(rows, write, "path string, members long, directory long", "media-manifest")[0]


class Range(InputPartition):
    def __init__(self, path: str, first: int, end: int) -> None:
        self.path, self.first, self.end = path, first, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest, self.folder = options.get("manifest"), options.get("path")
        self.step = int(options.get("rangeBytes", RANGE_BYTES))

    def archives(self) -> list[tuple[str, int]]:
        """Each archive and where its directory begins, from the manifest or else from the tails."""
        if self.manifest:
            with reader(self.manifest) as f:
                lines = f.read().decode().splitlines()
            return [(path, int(at)) for path, at in (x.rsplit("\t", 1) for x in lines)]
        from pyarrow import fs

        at, inside = filesystem(self.folder)
        found, out = at.get_file_info(fs.FileSelector(inside)), []
        for path in sorted(f"{self.folder}/{x.base_name}" for x in found if x.base_name.endswith(".arc")):
            with reader(path) as f:
                out.append((path, tail(f)[0]))
        return out

    def partitions(self) -> list[Range]:
        """Byte ranges of all archives' members."""
        found = self.archives()
        step = max(self.step, sum(end for _, end in found) // MOST_RANGES)
        out = [Range(path, s, min(s + step, end)) for path, end in found for s in range(0, max(end, 1), step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        f = reader(part.path)
        at, n = tail(f)
        rows, size = [], 0
        for name, offset, length, crc in entries(f, at, n, part.first, part.end):
            f, media = member(part.path, f, offset, length, crc)
            rows.append((name, offset, media))
            size += length
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        f.close()


def entries(f, at: int, n: int, first: int, end: int) -> list[tuple]:
    """``name, offset, length, crc`` of a directory's members that begin in a byte range.

    Entries have one size and stand in order of offset: the first is found by bisection, and no others than the range's are read, by blocks.
    """

    def some(k: int, count: int) -> list[tuple]:
        f.seek(at + k * ENTRY.size)
        return list(ENTRY.iter_unpack(f.read(min(count, n - k) * ENTRY.size)))

    low, high, out = 0, n if first > 0 else 0, []
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if some(middle, 1)[0][2] < first else (low, middle)
    while low < n:
        block = some(low, ENTRY_BLOCK)
        out += [(e[1] if e[0] else None, *e[2:]) for e in block if e[2] < end]
        if block[-1][2] >= end:
            break
        low += len(block)
    return out


def member(path: str, f, offset: int, length: int, crc: int):
    """The open file and one member's bytes, read again by its offset from a newly opened file if a read fails."""
    for attempt in range(RETRIES + 1):
        try:
            f.seek(offset)
            data = f.read(length)
            if len(data) == length and zlib.crc32(data) == crc:
                return f, data
            error: Exception = OSError(f"{path} at {offset}: the checksum is wrong")
        except OSError as e:
            error = e
        if attempt < RETRIES:
            time.sleep(0.1 * 2**attempt)
            f = reader(path)
    raise error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["name", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: ``name, offset, media``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, made: DataFrame) -> DataFrame:
    """The members of the archives that ``made(path, directory)`` lists; the list (a line an archive) is one file for the planner."""
    spark.dataSource.register(ArchiveSource)
    manifest = f"{new_folder(spark, 'media-list')}/archives"
    with writer(manifest) as f:
        for r in made.select("path", "directory").toLocalIterator():
            f.write(f"{r.path}\t{r.directory}\n".encode())
    return spark.read.format("media_archive").option("manifest", manifest).load()


def measured(media: DataFrame) -> DataFrame:
    """Digests and features of ``name, media``, all from the stored bytes."""
    schema = "name long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = body.as_py()
                samples, length = decode_png(data)
                payload = samples.tobytes()
                rows.append((name, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return mapped(media.select("name", "media"), run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Texts as archived images, read back: ``name`` (doc_id), digests and features."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text().cast("binary").alias("payload"))
    return measured(read_archives(spark, write_archives(rows, "doc_id", "payload", new_folder(spark, "media"))))
