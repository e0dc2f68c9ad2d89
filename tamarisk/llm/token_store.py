"""Token ids in sorted-string-table shards.

A shard holds documents in key order: prefix-compressed entries in blocks, a sparse index with the last key of
each block, a Bloom filter over all keys, and a fixed-size footer. A lookup reads footer, filter and index,
finds the block by binary search and reads only that block.

Keys are nine bytes that sort as the identifier does (null first). Repeated identifiers are kept as repeated
entries in order of their text's hash. A null text is empty and still gets its end id. An empty table gives no
shard. Columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.common import mapped, new_folder, reader, shuffle_parts, stored_map, whole_text, writer
from tamarisk.llm.tokens import encoder

MAGIC = b"TMRKSST1"
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 256 * 1024 * 1024
#: Small shards are read several to a task, up to so many bytes.
TASK_BYTES = 16 * 1024 * 1024
BITS_PER_KEY, PROBES = 10, 7
#: block index, filter: offset and length each; entries; ids; bytes of one id; magic
FOOTER = struct.Struct("<QQQQQQB8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits for each key's 64-bit hash, one row a probe."""
    a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (a + np.arange(PROBES, dtype=np.uint64)[:, None] * b) % np.uint64(bits)


def bloom(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(-(-bits // 8), np.uint8)
    for p in _probes(hashes, bits):
        np.bitwise_or.at(out, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    return out


class ShardWriter:
    """Takes entries in key order and writes one shard to an open stream."""

    def __init__(self, out, id_bytes: int = 2) -> None:
        self.out, self.id_bytes = out, id_bytes
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.first = self.newest = None
        self.hashes = array("Q")
        self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.newest is not None and key < self.newest:
            raise ValueError("keys must come in order")
        shared = 0
        while shared < len(self.last) and shared < len(key) and self.last[shared] == key[shared]:
            shared += 1
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = self.newest = key
        self.first = key if self.first is None else self.first
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.tokens += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block, self.last = bytearray(), b""

    def close(self) -> None:
        self._flush()
        index = bytearray()
        for key, at, n in self.index:
            put_varint(index, len(key))
            index += key
            put_varint(index, at)
            put_varint(index, n)
        bits = max(64, BITS_PER_KEY * len(self.hashes))
        filt = struct.pack("<Q", bits) + bloom(np.frombuffer(self.hashes, np.uint64), bits).tobytes()
        self.out.write(bytes(index) + filt)
        at = self.at
        self.out.write(FOOTER.pack(at, len(index), at + len(index), len(filt), len(self.hashes), self.tokens, self.id_bytes, MAGIC))


class Shard:
    """Reads a shard from a random-access file."""

    def __init__(self, f) -> None:
        self.f = f
        end = f.seek(0, 2)
        ix, ix_n, bl, bl_n, self.n_docs, self.n_tokens, self.id_bytes, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at = self._at(ix, ix_n), 0
        self.index: list[tuple[bytes, int, int]] = []
        while at < len(raw):
            n, at = get_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = get_varint(raw, at)
            length, at = get_varint(raw, at)
            self.index.append((bytes(key), offset, length))
        filt = self._at(bl, bl_n)
        self.bits, self.bloom = struct.unpack("<Q", filt[:8])[0], filt[8:]

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def _block(self, offset: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        raw, at, key = self._at(offset, n), 0, b""
        while at < n:
            shared, at = get_varint(raw, at)
            rest, at = get_varint(raw, at)
            size, at = get_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}")

    def may_have(self, key: bytes) -> bool:
        at = _probes(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), self.bits)[:, 0].tolist()
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in at)

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of a document (of the first of its entries), or None."""
        if not self.may_have(key):
            return None
        k = bisect.bisect_left(self.index, (key,))
        if k == len(self.index):
            return None
        return next((self.ids(v) for x, v in self._block(*self.index[k][1:]) if x == key), None)

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, offset, n in self.index:
            for key, value in self._block(offset, n):
                yield key, self.ids(value)


MANIFEST = "part int, shard int, path string, min_key binary, max_key binary, n_docs long, n_tokens long, n_bytes long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, kind: str = "word", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``doc_id, text`` and write shards in ascending id order; the manifest, in (part, shard) order of keys.

    One range exchange moves the texts; each task encodes its range in order and streams entries to the shard
    that is open, so memory holds one Arrow batch, one block, and a hash for each entry of the shard. A task that runs again writes a file of another
    name, and only files in the returned manifest count.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark, docs.count(), 25_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, shard = encoder(kind, tokenizer), TaskContext.get().partitionId(), 0
        end = struct.pack("<H", end_id)
        made, opened, w, path = [], None, None, ""

        def close():
            w.close()
            opened.__exit__(None, None, None)
            made.append((part, shard, path, w.first, w.newest, len(w.hashes), w.tokens, w.at))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if w is None:
                    path = f"{folder}/shard-{part:06d}-{shard:04d}-{uuid.uuid4().hex}.sst"
                    opened = writer(path)
                    w = ShardWriter(opened.__enter__())
                w.add(key_of(doc_id), enc.encode(text.as_py()) + end)
                if w.at >= shard_bytes:
                    close()
                    w, shard = None, shard + 1
        if w is not None:
            close()
        names = ["part", "shard", "path", "min_key", "max_key", "n_docs", "n_tokens", "n_bytes"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)

    return stored_map(rows, write, MANIFEST, "token-manifest")[0]


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (ids as the stored bytes) of every entry, a task for each shard or for several small ones.

    The manifest has a row a shard (of 256 MB where a task has as much), and its running sum of ids is kept by the driver.
    """
    shards, before, size = [], 0, 0
    for r in manifest.select("part", "shard", "path", "n_tokens", "n_bytes").orderBy("part", "shard").toLocalIterator():
        shards.append((r.path, before))
        before += r.n_tokens
        size += r.n_bytes
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    tasks = min(len(shards), max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))
    listed = spark.createDataFrame(shards, "path string, before long").repartition(tasks)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with reader(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for key, ids in Shard(f).scan():
                        rows.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        held += len(ids)
                        if len(rows) == 2000 or held > 500_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW)], names)

    return mapped(listed, read, "doc_id long, start long, n_tokens long, ids binary")


_ROW = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def store(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "word") -> DataFrame:
    """Write the ids of ``docs`` to fresh shards and read every document back from them."""
    spark = docs.sparkSession
    manifest = write_shards(docs, new_folder(spark, "token-shards"), tokenizer, end_id, kind)
    return read_shards(spark, manifest)


def lookup(manifest_rows: list[tuple[str, bytes, bytes]], doc_id: int | None) -> np.ndarray | None:
    """Point lookup over shards listed as (path, min_key, max_key) in key order: one shard's index and one block."""
    key = key_of(doc_id)
    k = bisect.bisect_left([m[2] for m in manifest_rows], key)
    if k == len(manifest_rows) or manifest_rows[k][1] > key:
        return None
    with reader(manifest_rows[k][0]) as f:
        return Shard(f).get(key)


def digests(read: DataFrame) -> DataFrame:
    """``crc32`` of the ids as little-endian unsigned 32-bit integers beside each document's place."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
