"""Language identification that fuses a text's likelihood with other evidence by Bayes' rule.

    P(l | text, declared, host) ~ P(text | l) P(declared | l) P(l | host)

The text model counts letter trigrams of a bounded labelled sample (``language_rows`` of each declared language). Its
posteriors over all rows are then summed by declared language, by host, by registered domain, by address suffix and
overall; each level's shares are smoothed by the level above with ``PSEUDO`` rows. A row's own posterior is taken out of every
sum that it is judged by. A further class ``und`` gives every trigram a low, equal probability: texts made of anything
but the known languages' letters end there.

Each letter stands in three trigrams, so a text's log-likelihood counts by a third (``WEIGHT``), whatever its length.

Null and empty texts have no trigrams and are ``und``; long ones are read whole. Missing or unknown hosts and declarations are
evidence-free: they share the empty host, or the empty declaration. Repeated rows count as often as they stand; empty
tables give no rows; other columns, whatever their names, are ignored (by ``known_language``: kept).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import mapped, resident, small_batches, stored, stored_map, whole_text

#: Rows of the sample for each declared language (in expectation).
LANGUAGE_ROWS = 2_000
#: Every declared language has a model; more of them than these aren't languages, and are an error.
LANGUAGES = 2_000
#: Trigrams of a language and of all together: where there are many languages, each has an equal share of these.
GRAMS, ALL_GRAMS = 20_000, 1_000_000
#: Words whose likelihoods a worker remembers, in a table of so many bytes, each of so many letters at most, and those that are summed at a time.
WORDS, WORD_BYTES, LONG_WORD, PART = 150_000, 32 * 1024 * 1024, 64, 10_000
UNKNOWN = "und"
#: Log-probability of any trigram under ``und``; what a trigram counts; rows of smoothing.
BACKGROUND, WEIGHT, PSEUDO = math.log(1 / 50_000), 1 / 3, 5.0
#: The posterior from which on another language than the declared one is taken for certain.
SURE = 0.999

_WORD = re.compile(r"[^\W\d_]+")
_DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def visible(html: str) -> str:
    """Text outside tags, scripts, styles and comments."""
    return _DROP.sub(" ", html)


class TextModel:
    """``log_likelihoods(text)``: one value a language and one for ``und``, each a mean over trigrams.

    ``table`` has of each trigram the languages that know it and by how much it is likelier there than one they don't know (``unseen``).
    """

    def __init__(self, languages: list[str], table: dict[str, list[tuple[int, float]]], unseen: list[float]) -> None:
        self.languages, self.table, self.unseen = languages, table, unseen
        self._at: dict[str, int] = {}
        width = len(languages) + 2
        self._rows = np.zeros((max(PART, min(WORDS, WORD_BYTES // (8 * width))), width))

    def _sums(self, word: str) -> list[float]:
        w, n, known = f" {word} ", len(word), self.table
        out = [x * n for x in self.unseen]
        for i in range(n):
            for lang, more in known.get(w[i : i + 3], ()):
                out[lang] += more
        return [*out, BACKGROUND * n, n]

    def _row(self, word: str) -> int:
        at = self._at[word] = len(self._at)
        self._rows[at] = self._sums(word)
        return at

    def log_likelihoods(self, text: str) -> tuple[list[float], int]:
        total = np.zeros(len(self.languages) + 2)
        words, known = _WORD.findall(text.lower()), self._at
        for at in range(0, len(words), PART):
            part = words[at : at + PART]
            rows = [known.get(w, -1) for w in part]
            if -1 in rows:
                if len(known) + len(part) > len(self._rows):
                    known.clear()
                for w in part:
                    if len(w) > LONG_WORD:
                        total += self._sums(w)
                rows = [known[w] if w in known else self._row(w) for w in part if len(w) <= LONG_WORD]
            total += self._rows[rows].sum(0)
        n = int(total[-1])
        return (total[:-1] / max(n, 1)).tolist(), n


def fit(sample: DataFrame) -> TextModel:
    """From a bounded sample ``lang, text``; what the driver takes is bounded by ``GRAMS`` a language and ``ALL_GRAMS`` together."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, k in Counter(_WORD.findall(text.as_py().lower())).items():
                    for g in grams(word):
                        n[lang, g] += k
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "gram", "n"])

    counts = stored(mapped(sample.select("lang", "text"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: (r.n, r.v) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    languages = sorted(totals)
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} declared languages; at most {LANGUAGES} have models")
    table: dict[str, list[tuple[int, float]]] = {}
    # however small the sample, what a language never has is likelier under und
    unseen = [min(math.log(1 / (totals[x][0] + totals[x][1] + 1)), BACKGROUND - 1) for x in languages]
    commonest = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("place", F.row_number().over(commonest)).where(F.col("place") <= min(GRAMS, ALL_GRAMS // max(1, len(languages))))
    best: dict[str, list[tuple[str, int]]] = {}
    for r in kept.orderBy("lang", "place").toLocalIterator():
        best.setdefault(r.lang, []).append((r.gram, r.n))
    for i, lang in enumerate(languages):
        n, v = totals[lang]
        for gram, k in best.get(lang, ()):
            table.setdefault(gram, []).append((i, math.log((k + 1) / (n + v + 1)) - unseen[i]))
    return TextModel(languages, table, unseen)


def sampled(docs: DataFrame, language_rows: int = LANGUAGE_ROWS) -> DataFrame:
    """About ``language_rows`` rows of each declared ``lang`` (all of a rarer one), by a hash of their identifier and text."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null").select(F.lower("lang").alias("lang"), "doc_id", "text")
    counts = rows.groupBy("lang").count()
    if (n := counts.count()) > LANGUAGES:
        raise ValueError(f"{n} declared languages; at most {LANGUAGES} have models")
    share = F.broadcast(counts.select("lang", (F.lit(float(language_rows)) / F.col("count")).alias("share")))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000.0 < F.col("share")
    return stored(rows.join(share, "lang").where(drawn).select("doc_id", "lang", "text"), "lang-sample")


def light_rows(rows: DataFrame, model: TextModel, html: bool) -> DataFrame:
    """``key.., host, declared, ll, n_grams, shares`` (the text's own posterior) in place of ``text``, which only this step reads."""
    spec = json.dumps([model.languages, model.table, model.unseen])
    keys = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", ll array<double>, n_grams long, shares array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = resident(("lang", spec), lambda: TextModel(*json.loads(spec)))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            got = [m.log_likelihoods(visible(t.as_py()) if html else t.as_py()) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            columns += [pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int64())]
            columns.append(pa.array([posterior(*g) for g in got], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, [*keys, "ll", "n_grams", "shares"])

    return stored_map(rows, run, schema, "lang-rows")[0]


def posterior(ll: list[float], n: int, *others: np.ndarray | None) -> list[float]:
    """Shares of the classes by the text's mean log-likelihoods over its trigrams and other likelihoods."""
    x = np.asarray(ll, float) * (n * WEIGHT)
    for other in others:
        if other is not None:
            x = x + np.log(other)
    x = np.exp(x - x.max())
    return (x / x.sum()).tolist()


def prior(own: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """A host's shares without the row's own, smoothed by what stands above; ``levels``: sums overall, of suffix, domain and host."""
    rest = np.maximum(levels[0] - own, 0.0)
    share = (rest + 1.0) / (rest.sum() + len(own))
    for level in levels[1:]:
        rest = np.maximum(level - own, 0.0)
        share = (rest + PSEUDO * share) / (rest.sum() + PSEUDO)
    return share


def fused(light: DataFrame, model: TextModel) -> DataFrame:
    """``light`` with ``lang``, ``confidence`` and the text's own ``text_lang``."""
    names = [*model.languages, UNKNOWN]
    k = len(names)
    parts = F.split("host", r"\.")
    light = light.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(""))
    light = light.withColumn("domain", F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.col("host")))
    sums = [F.sum(F.element_at("shares", i + 1)).alias(f"t{i}") for i in range(k)]
    again = [F.sum(f"t{i}").alias(f"t{i}") for i in range(k)]
    as_array = lambda name: F.array(*[f"t{i}" for i in range(k)]).alias(name)

    hosts = stored(light.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*again).select("domain", "suffix", as_array("of_domain"))
    suffixes = hosts.groupBy("suffix").agg(*again).select("suffix", as_array("of_suffix"))
    levels = hosts.select("host", "domain", "suffix", as_array("of_host")).join(domains, ["domain", "suffix"]).join(suffixes, "suffix")
    levels = stored(levels.select("host", "of_host", "of_domain", "of_suffix"), "host-sums")
    said = stored(light.where("declared != ''").groupBy("declared").agg(*sums), "declarations")
    totals = lambda rows: np.array([x or 0.0 for x in rows.agg(*again).first()], float)
    overall, n_said = totals(hosts), totals(said)
    out = light.join(levels, "host").join(said.select("declared", as_array("of_said")), "declared", "left")
    small_batches(light.sparkSession)

    @F.arrow_udf("struct<lang: string, confidence: double, text_lang: string>")
    def decide(ll: pa.Array, n: pa.Array, shares: pa.Array, h: pa.Array, d: pa.Array, s: pa.Array, q: pa.Array) -> pa.Array:
        rows = []
        for a, m, own, h_, d_, s_, q_ in zip(*[x.to_pylist() for x in (ll, n, shares, h, d, s, q)]):
            mine = np.array(own, float)
            likely = None if q_ is None else (np.maximum(np.array(q_, float) - mine, 0.0) + 0.5) / (np.maximum(n_said - mine, 0.0) + 10.0)
            post = posterior(a, m, prior(mine, [overall, *(np.array(x, float) for x in (s_, d_, h_))]), likely)
            best, text = int(np.argmax(post)), int(np.argmax(own))
            rows.append((names[best] if m else UNKNOWN, round(post[best], 6), names[text] if m else UNKNOWN))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string()))], ["lang", "confidence", "text_lang"])

    out = out.withColumn("decided", decide("ll", "n_grams", "shares", "of_host", "of_domain", "of_suffix", "of_said"))
    return out.select(*[c for c in light.columns if c not in ("ll", "shares", "suffix", "domain")], "decided.*")


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag: two or three letters, else empty."""
    return F.coalesce(F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1)), F.lit(""))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, host, declared, n_grams, lang, confidence, text_lang`` of every row."""
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][\w-]*)", 1)
    rows = pages.select("page_id", host_of("url").alias("host"), primary(declared).alias("declared"), F.coalesce("html", F.lit("")).alias("text"))
    return fused(light_rows(rows, model, html=True), model)


def known_language(docs: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """The documents whose language is one of the model's and, where that is declared too, the declared one.

    Source and declared language are evidence; a text goes against its declaration where another language's posterior is
    ``SURE`` at least, which for a short text its own few trigrams must bring about.
    Decisions are made on rows without text; those rejected are then taken away by identifier and text hash.
    """
    tie = F.xxhash64(whole_text())
    rows = docs.select(F.col("doc_id").alias("k"), tie.alias("h"), F.coalesce("source", F.lit("")).alias("host"), primary(F.col("lang")).alias("declared"), whole_text().alias("text"))
    sure = F.col("confidence") >= SURE
    against = F.col("declared").isin(*model.languages) & (F.col("lang") != F.col("declared")) & sure if model.languages else F.lit(False)
    doubtful = (F.col("lang") == UNKNOWN) | (F.col("confidence") < least) | against
    out = fused(light_rows(rows, model, html=False), model).where(doubtful).select("k", "h").distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("rk"), tie.alias("rh"))
    return marked.join(out, F.col("rk").eqNullSafe(F.col("k")) & (F.col("rh") == F.col("h")), "left_anti").select("row.*")
