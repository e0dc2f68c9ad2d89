"""Winnowing fingerprints of whole texts.

Rolling hashes of all k-grams of code points; in each window of ``WINDOW`` consecutive ones the least is chosen, the
rightmost where several are least. Chosen hashes are kept with their positions: two texts that share any passage of
``K + WINDOW - 1`` code points share a chosen hash there. A text shorter than a k-gram has one hash of the whole, at
position 0; the empty text has none. Null text is empty. Likeness is the Jaccard similarity of the chosen hashes
(two empty fingerprints: 1).

``edited_pairs`` orders documents by descending ``doc_id`` (ties by text, null ids last; the last is followed by the
first). Equal rows follow each other; a single document is followed by itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import mapped, shuffle_parts, whole_text

#: One window for all lengths, so that equal passages match across lengths; half of any text of 78 code points or more has a guaranteed hash.
K, WINDOW = 24, 16
#: Code points handled at once; positions in a block fit the low bits of what the minimum is taken of.
BLOCK, POS_BITS = 1 << 18, 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = _U(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_UP, _DOWN = _powers(_BASE, BLOCK + K + WINDOW), _powers(_INVERSE, BLOCK + K + WINDOW)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    return h ^ (h >> _U(29))


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-grams of at most a block of code points, by differences of one running sum."""
    n = len(points)
    k = min(k, n)
    if not n:
        return np.empty(0, _U)
    run = np.zeros(n + 1, _U)
    np.cumsum((points.astype(_U) + _U(1)) * _DOWN[:n], dtype=_U, out=run[1:])
    return _mixed((run[k:] - run[:-k]) * _UP[: n - k + 1])


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values, by doubling."""
    size, out = 1, x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1])


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 32 bits, positions) chosen from a text, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = max(1, len(points) - k + 1) if len(points) else 0
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    hashes, places = [], []
    step = BLOCK
    for at in range(0, max(1, n - window + 1), step):
        h = gram_hashes(points[at : at + step + k + window - 2], k) >> _U(32)
        low = (1 << POS_BITS) - 1 - np.arange(len(h))
        packed = h << _U(POS_BITS) | low.astype(_U)
        least = np.unique(window_minima(packed, min(window, len(packed))))
        hashes.append((least >> _U(POS_BITS)).astype(np.uint32))
        places.append(at + (1 << POS_BITS) - 1 - (least & _U((1 << POS_BITS) - 1)).astype(np.int64))
    h, p = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(p, kind="stable")
    h, p = h[order], p[order]
    keep = np.concatenate(([True], p[1:] != p[:-1]))
    return h[keep], p[keep]


def written(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash@position`` of each chosen hash, in order."""
    return " ".join([f"{h:08x}@{p}" for h, p in zip(chosen[0].tolist(), chosen[1].tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they and the next document's are.

    Ranges of identifiers are dealt out whole, each with a copy of the next range's first document, so one exchange
    of the texts brings every document to its successor. The ranges' bounds and their greatest identifiers are one
    row a range, which the driver holds; there are 10,000 ranges at most (or the session's shuffle partitions), larger ones on larger tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = shuffle_parts(spark, docs.count(), 20_000, 10_000)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first().c if n > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def parts(ids: list[int | None]) -> list[int]:
        """Part 0 holds the ids above the highest cut, and so on down; null ids are in the last."""
        low = np.iinfo(np.int64).min
        return (len(cuts) - np.searchsorted(cuts, np.array([low if x is None else x for x in ids], np.int64), "left")).tolist()

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array(parts(ids.to_pylist()), pa.int32())

    tops = [(r.part, r.top) for r in rows.groupBy(part_of("doc_id").alias("part")).agg(F.max("doc_id").alias("top")).orderBy("part").collect()]
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    last = tops[-1][0]
    before = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}

    @F.arrow_udf("array<int>")
    def dealt_to(ids: pa.Array) -> pa.Array:
        """Twice the part, and for a part's first id twice the part before it and one."""
        found = ids.to_pylist()
        return pa.array([[2 * p, *([2 * before[x] + 1] if x in before else [])] for x, p in zip(found, parts(found))], pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "text", F.explode(dealt_to("doc_id")).alias("to"))
    dealt = dealt.select("doc_id", "text", F.expr("to div 2").cast("int").alias("part"), F.expr("to % 2").alias("copy"))
    dealt = dealt.repartitionById(last + 1, "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, out = None, []
        for batch in batches:
            for doc_id, text, part, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = text.as_py()
                if copy and held is None:
                    continue
                mine = winnow(t)
                if held is not None:
                    changed = edited(held[1], t)
                    other = winnow(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], len(held[1]), digest, written(held[2]), written(other), likeness(held[2][0], other[0]), likeness(held[2][0], mine[0])))
                held = None if copy else (doc_id, t, mine)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names)

    return mapped(dealt, run, SCHEMA)
