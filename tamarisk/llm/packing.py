"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bounded-space online best-fit: at most ``open_bins`` sequences are open at a time, found through a bitset keyed
by free space. A piece goes to the open sequence whose free space is the least that suffices; if there's none,
a new one opens, and if that is one too many, the fullest open sequence closes.

A null text is empty and still has its end id; repeated rows are packed each; an empty table gives no rows.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import mapped, whole_text
from tamarisk.llm.tokens import encoder

OPEN_BINS = 2048
#: Documents that one packing task takes: enough that what stays open at its end is a small part.
GROUP_DOCS = 8192
#: Beyond so many tasks, which a driver can plan, groups get larger instead.
MOST_GROUPS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class BestFit:
    """The open sequences of one task: ``place(n)`` gives (sequence, offset)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels = 0  # bit s: some open sequence has s places free
        self.count = self.made = 0

    def _take(self, space: int) -> int:
        at = self.free[space]
        b = at.pop()
        if not at:
            self.levels &= ~(1 << space)
        self.count -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} doesn't fit {self.capacity}")
        fits = self.levels >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            space, b = self.capacity, self.made
            self.made += 1
        if space > n:
            if self.count == self.limit:
                self._take((self.levels & -self.levels).bit_length() - 1)
            self.free[space - n].append(b)
            self.levels |= 1 << (space - n)
            self.count += 1
        return b, self.capacity - space


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    first = n % capacity or capacity
    return [(0, n)] if n <= capacity else [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, kind: str = "byte") -> DataFrame:
    """Encode ``doc_id, text``, append ``end_id`` and cut what is longer than ``capacity``.

    ``ids`` are little-endian unsigned 16-bit integers; ``ids_crc32`` is taken of them as 32-bit ones.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(kind, tokenizer), struct.pack("<H", end_id)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                for k, (s, n) in enumerate(cut(len(ids) // 2, capacity)):
                    part = ids[2 * s : 2 * (s + n)]
                    crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                    for col, v in zip(out, (doc_id, k, s, n, part, crc)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], _NAMES)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), make, PIECES)


_NAMES = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


def pack(cut_pieces: DataFrame, n_docs: int, capacity: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """Place every piece; ``n_docs`` sets how many tasks share the work.

    Pieces are dealt by a hash of identifier, position and content, so that no source or long document fills a
    task, and are taken in the order of another hash: the same order whenever a task runs again, and unrelated to
    length, which a bounded number of open sequences needs.
    """
    groups = max(1, min(MOST_GROUPS, round(n_docs / GROUP_DOCS)))
    deal = cut_pieces.withColumn("_at", F.xxhash64("doc_id", "piece", "ids_crc32"))
    deal = deal.repartition(groups, "_at").sortWithinPartitions(F.xxhash64("_at"), "doc_id", "piece").drop("_at")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [fit.place(n) for n in batch.column(3).to_pylist()]
            new = [pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*_NAMES, "sequence_id", "offset"])

    return mapped(deal, place, PACKED)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, capacity), docs.count(), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids in order and the documents' boundaries, at most ``capacity`` ids each."""
    put = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(put.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("members"))


def digests(packed: DataFrame) -> DataFrame:
    """The packed rows without the ids, which ``ids_crc32`` stands for."""
    return packed.drop("ids")
