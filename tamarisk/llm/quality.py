"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A word is a run of letters, a run of digits or a run of other visible characters. Each text gives the n-grams of up to
``WORDS`` lower-cased words and those of up to ``SHAPES`` words' shapes (how a word is written, whether white space stands before it, whether it repeats the
word before; a run of other characters is its own shape), since most n-grams of prose are rare and their shapes aren't. N-grams are hashed
to ``BUCKETS`` and counted, and a text's counts have length 1; a score is the sparse product of counts and weights.

Training takes at most ``sample_rows`` labelled rows, chosen by a hash of their identifier. Their counted n-grams go, in the order of that hash and
``passes`` times, through one task that keeps a gradient's sum and its squares a bucket and nothing else: updates depend on those before. Weights under the
regularisation stay 0, so few buckets leave the task. All else, n-grams, counts and scores, is each row's own.

Null and empty texts score the model's bias, long texts are read whole in slices (a word of more than ``SLICE`` letters counts as several), repeated rows
are scored each. Rows with a null ``doc_id`` aren't held out. Null labels and labels of no document are ignored; a document labelled twice is good if all its labels say so.
Without labels all scores are 0.5; with one class only, all lean to it. Empty tables give no rows; other columns, whatever their names, are ignored by ``scores`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import mapped, resident, small_batches, stored, whole_text

SAMPLE_ROWS = 12_000
BUCKETS = 1 << 20
WORDS, SHAPES = 2, 4
SLICE = 1 << 18
#: Of the updates: step and its damping, and what weighs on a weight's size and its square.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.3, 0.1, 2

_SPACE, _LOWER, _UPPER, _DIGIT, _OTHER = range(5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its class, and its lower case where that is one code point."""
    kind, lower = np.full(0x110000, _OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            small = x.lower()
            kind[c] = _UPPER if small != x else _LOWER
            if len(small) == 1:
                lower[c] = ord(small)
        elif x.isspace():
            kind[c] = _SPACE
        elif x.isnumeric():
            kind[c] = _DIGIT
    return kind, lower


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse: sums of a slice's letters times powers give each word's hash by two look-ups."""
    up, down = np.full(SLICE + 1, _ODD, np.uint64), np.full(SLICE + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE)) + 1
        end = end if end > at else at + SLICE
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words and codes of their shapes, without the flag of repetition."""
    kinds, lower = _tables()
    up, down = _powers()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    group = np.where(kind == _UPPER, _LOWER, kind)
    first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
    last = np.append(first[1:], len(points))
    seen = group[first] != _SPACE
    glued = np.append(False, seen[:-1])[seen]
    first, last = first[seen], last[seen]
    sums = np.append(np.uint64(0), np.cumsum((lower[points].astype(np.uint64) + np.uint64(1)) * up[: len(points)]))
    words = _mixed((sums[last] - sums[first]) * down[first] + group[first].astype(np.uint64))
    capitals = np.append(0, np.cumsum(kind == _UPPER))
    n, begins = capitals[last] - capitals[first], kind[first] == _UPPER
    form = np.where(n == 0, 0, np.where((n == last - first) & (n > 1), 3, np.where(begins & (n == 1), 1, 2)))
    shape = (group[first].astype(np.uint64) << np.uint64(4)) | (form.astype(np.uint64) << np.uint64(1)) | glued.astype(np.uint64)
    return words, np.where(group[first] == _OTHER, words << np.uint64(10) | shape, shape)


def _grams(codes: np.ndarray, most: int, skip: int, salt: int) -> list[np.ndarray]:
    """Hashes of the n-grams of up to ``most`` codes that end after the first ``skip``."""
    out, h = [], np.full(len(codes), np.uint64(salt))
    for n in range(most):
        h = _mixed((h[:-1] if n else h) * np.uint64(0x94D049BB133111EB) + codes[n:])
        out.append(h[max(0, skip - n):])
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, each once, and their counts as a vector of length 1."""
    most, buckets, n = max(WORDS, SHAPES), np.zeros(0, np.uint32), np.zeros(0)
    words, shapes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for part in _slices(text):
            w, s = _words(part)
            skip = len(words)
            words, shapes = np.concatenate((words, w)), np.concatenate((shapes, s))
            again = np.append(False, words[1:] == words[:-1])
            flagged = shapes | (again.astype(np.uint64) << np.uint64(3))
            h = np.concatenate(_grams(words, WORDS, skip, 1) + _grams(flagged, SHAPES, skip, 2))
            now, c = np.unique((h % np.uint64(BUCKETS)).astype(np.uint32), return_counts=True)
            if len(buckets):
                now, at = np.unique(np.concatenate((buckets, now)), return_inverse=True)
                c = np.bincount(at, np.concatenate((n, c)))
            buckets, n = now, c.astype(float)
            words, shapes = words[-most:], shapes[-most:]
    return buckets, n / max(1.0, float(np.sqrt((n * n).sum())))


class Model(NamedTuple):
    """Weights of the buckets that have one, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


class Leader:
    """Follow the regularised leader: each bucket's weight minimises all gradients so far and the regularisation."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # the last place is the bias, which nothing weighs on
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == BUCKETS, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + np.where(at == BUCKETS, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> float:
        """One update; gives the loss before it."""
        at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return float(-np.log(max(p if label else 1 - p, 1e-12)))

    def model(self) -> Model:
        every = self.weights(np.arange(BUCKETS + 1))
        kept = np.flatnonzero(every[:-1])
        return Model(kept, every[kept], float(every[-1]))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, passes: int = PASSES) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out; what one task and the driver take is bounded by ``sample_rows`` and ``BUCKETS``."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sample = texts.join(F.broadcast(known), "doc_id").select("place", "doc_id", "quality", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t.as_py()) for t in batch.column(3)]
            at = [pa.array(x[0].astype(np.int32)) for x in found]
            values = [pa.array(x[1].astype(np.float32)) for x in found]
            ends = np.cumsum([0, *map(len, at)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(x) if x else pa.array([], k)) for x, k in ((at, pa.int32()), (values, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["place", "doc_id", "quality", "buckets", "counts"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader()
        for batch in batches:
            for at, values, label in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                leader.learn(at.values.to_numpy(), values.values.to_numpy(zero_copy_only=False).astype(float), label)
        m = leader.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.buckets, BUCKETS), pa.int64()), pa.array(np.append(m.weights, m.bias), pa.float64())], ["bucket", "weight"])

    rows = stored(mapped(sample, count, "place long, doc_id long, quality int, buckets array<int>, counts array<float>"), "quality-sample")
    order = ["pass", "place", "doc_id", "counts"]
    rows = rows.select(F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"), "*").repartition(1).sortWithinPartitions(*order)
    got = mapped(rows.select("buckets", "counts", "quality"), learn, "bucket long, weight double").orderBy("bucket").toPandas()
    if not len(got):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    buckets, weights = got["bucket"].to_numpy(), got["weight"].to_numpy()
    return Model(buckets[:-1], weights[:-1], float(weights[-1]))


def score_of(model: Model, dense: np.ndarray, text: str) -> float:
    buckets, values = counted(text)
    return float(1 / (1 + np.exp(-np.clip(dense[buckets] @ values + model.bias, -30, 30))))


def scorer(model: Model):
    """A column function: the score of a whole text (a string column, null as empty)."""
    name = hash((model.buckets.tobytes(), model.weights.tobytes(), model.bias))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        dense = resident(("quality", name), model.dense)
        return pa.array([score_of(model, dense, t.as_py()) for t in text], pa.float64())

    return lambda col: score(whole_text(col))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    small_batches(docs.sparkSession)
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier calls good."""
    small_batches(docs.sparkSession)
    score = scorer(train(docs, labels))
    return docs.select(F.struct("*").alias("row"), score("text").alias("score")).where("score >= 0.5").select("row.*")
