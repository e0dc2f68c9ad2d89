"""Toxicity scores from a classifier whose scores shouldn't depend on the group that a text mentions.

Features are words and word beginnings, as present or not in the whole text, and always the identity terms. A bounded
sample of labelled rows (``sample_rows``) fits them: grouped counts over the sample choose the features that tell the
classes apart, and logistic regression weighs them. How far a feature must tell them apart is chosen by the loss on a
fold of the sample itself.

For the counterfactual term each sentence of a labelled text that names an identity group is paired with the same
sentence naming the other groups of its kind; where a neutral text names none, a group is put into one of its sentences. The
loss adds ``counterfactual`` times the mean squared difference of the two logits, so what the sample happens to say
along with a group's name is no evidence. Every sixteenth text of either class that names no group is also learned with one named in it, under its own label, so that
terms have weights to be held together even where a sample (as invented prose) names none. ``group_gap`` says what is left: by how much a text's score can change at most
between naming one group of a kind and another.

Null and empty texts score the model's base rate, long ones are read whole, and rows that repeat are scored each. Rows with
a null ``doc_id`` aren't held out. Labels of null or of documents that aren't there are ignored, and a document labelled
twice is toxic if either label says so. Without a label of each class all scores are next to 0. Empty tables give no
rows; other columns, whatever their names, are ignored by ``scores`` and kept by ``clean``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import Bounded, mapped, resident, small_batches, stored, whole_text

SAMPLE_ROWS = 20_000
FEATURES = 4096
#: A feature is used if so many sampled documents have it, and its log-odds are so far from 0 and so many standard errors:
#: by the pair of these with the least loss on one in ``FOLDS`` sampled rows, which isn't fitted then.
MIN_DOCS, MIN_ODDS, FOLDS = 3, ((1.25, 2.5), (1.75, 1.5), (1.75, 2.5), (2.5, 1.5), (2.5, 2.5)), 4
PREFIXES = (4, 5, 6)
#: Words that name a group, by kind of group; each kind in one language and form.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "mexican", "chinese", "german", "french", "spanish"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
)

_WORD, _STOP = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n\u3002\uff01\uff1f]+")
_OTHERS: dict[str, tuple[str, ...]] = {}
for _kind in IDENTITY_TERMS:
    for _term in _kind:
        _OTHERS[_term] = (*_OTHERS.get(_term, ()), *(x for x in _kind if x != _term))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Each word, and its first letters marked with a star."""
    out = set(words)
    for k in PREFIXES:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


def swapped(words: set[str]) -> list[set[str]]:
    """The counterfactuals of a sentence's words: each identity term by each other of its kind."""
    return [words - {w} | {x} for w in sorted(words & _OTHERS.keys()) for x in _OTHERS[w]]


def told(text: str) -> list[set[str]]:
    """The words of the sentences that name a group, or else of the longest sentence."""
    sentences = [words_of(s) for s in _STOP.split(text)]
    return [s for s in sentences if s & _OTHERS.keys()] or [max(sentences, key=len)]


class Model:
    """``weights`` of features and ``bias``."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._known = Bounded()

    def logit(self, words: set[str]) -> float:
        w, known, found = self.weights, self._known, set()
        for word in words:
            f = known.get(word)
            if f is None:
                f = tuple(x for x in features_of((word,)) if x in w)
                known.put(word, f, 50 * len(f))
            if f:
                found.update(f)
        return self.bias + sum(w[f] for f in sorted(found))

    def spreads(self) -> list[tuple[float, float]]:
        """Of each kind of groups the least and greatest that naming one adds to a text's logit, where these differ."""
        adds = lambda term: sum(self.weights.get(f, 0.0) for f in sorted(features_of((term,))))
        ends = ((min(map(adds, kind)), max(map(adds, kind))) for kind in IDENTITY_TERMS)
        return sorted({(a, b) for a, b in ends if a != b})

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -30, 30))))


Row = tuple[int, set[str], list[set[str]]]


def pairs_of(rows: list[Row]) -> list[tuple[set[str], set[str]]]:
    """Sentences and their counterfactuals; each sixteenth neutral text without a group gets one named."""
    terms, out = [kind[0] for kind in IDENTITY_TERMS], []
    for k, (label, _, sentences) in enumerate(rows):
        for words in sentences:
            if not words & _OTHERS.keys() and not label and k % 16 == 0:
                words = words | {terms[k // 16 % len(terms)]}
            out += [(words, x) for x in swapped(words)]
    return out


def named(rows: list[Row]) -> list[Row]:
    """Copies of every sixteenth text of either class that names no group, with one named, all of them in turn."""
    terms, seen, out = sorted(_OTHERS), [0, 0], []
    for label, words, sentences in rows:
        if not words & _OTHERS.keys():
            if seen[label] % 16 == 0:
                term = terms[len(out) % len(terms)]
                out.append((label, words | {term}, [s | {term} for s in sentences[:1]]))
            seen[label] += 1
    return out


def fit(rows: list[Row], vocabulary: list[str], l2: float = 1e-3, counterfactual: float = 1.0, steps: int = 400) -> Model:
    """Logistic regression over (label, words, sentences' words) with the counterfactual penalty, by Adam on the whole sample."""
    at = {f: i for i, f in enumerate(dict.fromkeys([*vocabulary, *_OTHERS]))}
    index = lambda words: sorted(at[f] for f in features_of(words) if f in at)
    rows = [*rows, *named(rows)]

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    y = np.array([r[0] for r in rows], float)
    r, c = matrix([index(r[1]) for r in rows])
    pairs = [(index(a), index(b)) for a, b in pairs_of(rows)]
    ra, ca = matrix([p[0] for p in pairs])
    rb, cb = matrix([p[1] for p in pairs])
    n, v, m = len(rows), len(at), max(1, len(pairs))
    w, b = np.zeros(v), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    mom, var, mb, vb = np.zeros(v), np.zeros(v), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], n) + b, -30, 30)))
        e = (p - y) / n
        g = np.bincount(c, e[r], v) + l2 / v * w
        if pairs:
            d = np.bincount(ra, w[ca], len(pairs)) - np.bincount(rb, w[cb], len(pairs))
            d = 2 * counterfactual * d / m
            g += np.bincount(ca, d[ra], v) - np.bincount(cb, d[rb], v)
        gb = e.sum()
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.1 / (1 + t / 100) / (1 - 0.9**t)
        w -= step * mom / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, float(b))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chosen_features(rows: list[Row], odds: dict[str, tuple[float, float]], counterfactual: float) -> list[str]:
    """Those of the features (with log-odds and their number of standard errors) that give the least loss on the fold that isn't fitted."""
    of = lambda pair: [f for f, (x, e) in odds.items() if abs(x) >= pair[0] and e >= pair[1]]
    fitted, held = [r for k, r in enumerate(rows) if k % FOLDS], [r for k, r in enumerate(rows) if k % FOLDS == 0]
    if not {0, 1} <= {r[0] for r in fitted} or not held:
        return of(MIN_ODDS[-1])

    def loss(pair: tuple[float, float]) -> float:
        m = fit(fitted, of(pair), counterfactual=counterfactual, steps=120)
        z = np.clip(np.array([m.logit(r[1]) for r in held]) * np.array([1 - 2 * r[0] for r in held]), -30, 30)
        return float(np.log1p(np.exp(z)).mean())

    return of(min(MIN_ODDS, key=lambda x: (loss(x), x)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, counterfactual: float = 1.0) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out, chosen by a hash of their identifier.

    Everything the driver takes is bounded by ``sample_rows`` and ``FEATURES``.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sample = stored(texts.join(F.broadcast(known), "doc_id").select("toxic", "text"), "toxic-sample")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for f in features_of(words_of(text.as_py())):
                    n.setdefault(f, [0, 0])[y] += 1
            if len(n) > 100_000:
                yield _counts(n)
                n = {}
        yield _counts(n)

    size = dict(sample.groupBy("toxic").count().collect())
    if len(size) < 2:
        return Model({}, -30.0)
    per = mapped(sample, counted, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (size[1] + 1)) - F.log((F.col("neg") + 0.5) / (size[0] + 1))
    gain = F.abs(odds) * F.sqrt(F.col("pos") / size[1] + F.col("neg") / size[0])
    errors = F.abs(odds) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    telling = (F.col("neg") + F.col("pos") >= MIN_DOCS) & (F.abs(odds) >= min(x for x, _ in MIN_ODDS)) & (errors >= min(e for _, e in MIN_ODDS))
    best = per.where(telling).orderBy(gain.desc(), "f").limit(FEATURES)
    vocabulary = {r.f: (r.odds, r.errors) for r in best.select("f", odds.alias("odds"), errors.alias("errors")).collect()}
    wanted = frozenset(vocabulary) | _OTHERS.keys()

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = lambda words: [w for w in sorted(words) if not wanted.isdisjoint(features_of((w,)))]
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            words = pa.array([keep(words_of(t)) for t in texts], pa.list_(pa.string()))
            sentences = pa.array([[keep(x) for x in told(t)] for t in texts], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, sentences], ["toxic", "words", "sentences"])

    got = mapped(sample, chosen, "toxic int, words array<string>, sentences array<array<string>>").toLocalIterator()
    rows = sorted(((r.toxic, r.words, r.sentences) for r in got))
    rows = [(y, set(words), [set(x) for x in sentences]) for y, words, sentences in rows]
    return fit(rows, chosen_features(rows, vocabulary, counterfactual), counterfactual=counterfactual)


def _counts(n: dict[str, list[int]]) -> pa.RecordBatch:
    v = list(n.values())
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64())], ["f", "neg", "pos"])


def scorer(model: Model):
    """A column function: the score of a whole text (a string column, null as empty)."""
    spec = json.dumps([model.weights, model.bias])

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        m = resident(("toxicity", spec), lambda: Model(*json.loads(spec)))
        return pa.array([m.score(t.as_py()) for t in text], pa.float64())

    return lambda col: score(F.coalesce(F.col(col), F.lit("")))


def group_gap(model: Model, score: Column) -> Column:
    """The greatest difference of a text's scores between two groups of a kind, in a text that names neither."""
    odds = F.log(score / (1 - score))
    sure = lambda add: 1 / (1 + F.exp(-(odds + F.lit(add))))
    gaps = [sure(b) - sure(a) for a, b in model.spreads()]
    return F.greatest(F.lit(0.0), *gaps) if gaps else F.lit(0.0)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, group_gap`` of every row."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), scorer(model)("text").alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"), group_gap(model, F.col("score")).alias("group_gap"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't call toxic."""
    small_batches(docs.sparkSession)
    score = scorer(train(docs, labels))
    rows = docs.select(F.struct("*").alias("row"), score("text").alias("score")).where("score < 0.5")
    return rows.select("row.*")
