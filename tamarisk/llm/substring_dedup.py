"""Removal of passages that an earlier place of the corpus already has.

Units are normalised and digested to 128 bits, and digests are grouped over the whole corpus with their least rank
(doc_id, then text hash, then position). A unit that isn't the first of its digest is removed; the first stays as it
was. Offsets always refer to the original text, in code points.

A unit is a line, a paragraph, or (``unit="run"``) any ``RUN`` words in a row, wherever in a line they begin and end.
Lines and paragraphs are compared in lower case with single spaces; those of fewer than ``min_words`` words stay, and an
empty one is never removed. They miss passages inside longer lines, and short ones take boilerplate from documents that
share nothing else, so op1 and the pipeline use runs.

Runs: words are lower-cased and cut at ASCII white space; each character of a script without spaces is a word.
Every word of a run that stood at an earlier place goes, with the white space before it; a line break in what goes is
kept. A run that overlaps its own first place stays. A place is given away by the least hash of ``GRAM`` words in it
(winnowing): two equal runs choose the same one, so only around chosen hashes that repeat are runs digested and grouped, and
no repeated run is missed. A text that as a whole stands at an earlier place loses all its runs without being looked into.

Null text is empty and has one empty line and no word. A null ``doc_id`` ranks before all others. Rows that repeat both
``doc_id`` and text count as one document and are treated alike. Empty tables give empty results. Other columns,
whatever their names, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import mapped, salted, small_batches, stored, stored_map, whole_text
from tamarisk.llm.fingerprints import BLOCK, POS_BITS, gram_hashes, window_minima

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: Words of a run, and of the hashes chosen in it.
RUN, GRAM = 50, 25
#: Stands for all runs of a text.
WHOLE = [-1]
#: Rows of an Arrow batch that a task puts out.
OUT_ROWS = 20_000

#: Ranges of scripts that are written without spaces.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
_WORD = re.compile(f"[{UNSPACED}]|[^\x09-\x0d\x20{UNSPACED}]+")


def normal(unit: str) -> tuple[bytes, int]:
    """The normalised unit and its number of words."""
    words = unit.lower().encode("utf-8", "surrogatepass").split()
    return b" ".join(words), len(words)


def _split(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), whole_text().alias("text"))


_NAMES, _TYPES = ["doc_id", "tie", "unit", "hi", "lo"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
_UNITS = "doc_id long, tie long, unit int, hi long, lo long"


def unit_rows(docs: DataFrame, unit: str = "line", min_words: int = 5) -> DataFrame:
    """``doc_id, tie, unit, hi, lo`` of the lines or paragraphs that are long enough."""
    sep = SEPARATORS[unit]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for k, piece in enumerate(text.as_py().split(sep)):
                    text_, n = normal(piece)
                    if n >= max(1, min_words):
                        for col, v in zip(out, (doc_id, tie, k, *_split(xxhash.xxh3_128_intdigest(text_)))):
                            col.append(v)
                if len(out[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], _NAMES)
                    out = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], _NAMES)

    return mapped(_keyed(docs), run, _UNITS)


def repeats(units: DataFrame, length: int = 1) -> DataFrame:
    """``doc_id, tie, removed`` (positions of units) of the documents that lose something.

    Units of more than one position aren't repeats of a first one that they overlap.
    """
    place = F.struct("doc_id", "tie", "unit")
    first = units.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    # written, so that the join deals both sides anew and adaptive execution can split a unit that very many places have
    first = stored(first.select("hi", "lo", "first"), "first-units")
    later = units.join(first, ["hi", "lo"]).where(~place.eqNullSafe(F.col("first")))
    if length > 1:
        own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
        later = later.where(~(own & (F.col("unit") < F.col("first.unit") + length)))
    return later.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("unit")).alias("removed"))


def without_units(text: str, gone: list[int], sep: str) -> tuple[str, int, int, str]:
    """The text without the lines or paragraphs at the given positions, their number, the removed ones' and their spans."""
    lost, kept, spans, at = set(gone), [], [], 0
    units = text.split(sep)
    for k, u in enumerate(units):
        if k in lost:
            spans.append(f"{at}-{at + len(u)}")
        else:
            kept.append(u)
        at += len(u) + len(sep)
    return sep.join(kept), len(units), len(lost), ",".join(spans)


def without_runs(text: str, starts: list[int]) -> tuple[str, int, int, str]:
    """The same for the runs that begin at the given words (ascending); units are words."""
    words = [m.span() for m in _WORD.finditer(text)]
    if not starts:
        return text, len(words), 0, ""
    parts: list[list[int]] = []
    if starts == WHOLE:
        parts = [[0, len(words)]] if len(words) >= RUN else []
        starts = []
    for i in starts:
        if parts and i <= parts[-1][1]:
            parts[-1][1] = i + RUN
        else:
            parts.append([i, i + RUN])
    out, at, lost = [], 0, 0
    for i, j in parts:
        begin, end = words[i - 1][1] if i else 0, words[j - 1][1]
        out.append(text[at:begin])
        at = end
        if j < len(words):
            if not i:
                at = words[j][0]
            elif "\n" in text[begin:end] and "\n" not in text[end : words[j][0]]:
                out.append("\n")
                at = words[j][0]
        lost += j - i
    return "".join(out) + text[at:], len(words), lost, ",".join(f"{words[i][0]}-{words[j - 1][1]}" for i, j in parts)


def word_hashes(text: str) -> np.ndarray:
    """One hash a word of the lower-cased text."""
    low, one = text.lower(), xxhash.xxh3_64_intdigest
    if _ANY_UNSPACED.search(low):
        words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(low)]
    else:
        words = low.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(one, words), np.uint64, len(words))


def chosen_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of ``GRAM`` words, and for each run of ``RUN`` words the place of its least one, the last of equals."""
    if len(words) < RUN:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    step, window, mask = BLOCK // 2, RUN - GRAM + 1, (1 << POS_BITS) - 1
    hashes = np.concatenate([gram_hashes(words[at : at + step + GRAM - 1], GRAM) for at in range(0, len(words) - GRAM + 1, step)])
    places = []
    for at in range(0, len(words) - RUN + 1, step):
        h = hashes[at : at + step + window - 1] >> np.uint64(32)
        packed = h << np.uint64(POS_BITS) | (mask - np.arange(len(h))).astype(np.uint64)
        places.append(at + mask - (window_minima(packed, window) & np.uint64(mask)).astype(np.int64))
    return hashes, np.concatenate(places)


def gram_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, unit, h, several, salt`` of the chosen grams; ``unit`` is the first word's place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, at = [], [], 0
            found: list[tuple[np.ndarray, ...]] = []
            for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes, places = chosen_grams(word_hashes(text.as_py()))
                if len(places):
                    units = np.unique(places)
                    found.append((np.full(len(units), at, np.int64), units, hashes[units]))
                    ids.append(doc_id)
                    ties.append(tie)
                    at += 1
            if not found:
                continue
            doc, unit, h = map(np.concatenate, zip(*found))
            order, several, salt = salted(h, hashes_of(doc, unit))
            doc, unit, h = pa.array(doc[order]), unit[order], h[order].view(np.int64)
            columns = [pa.array(ids, pa.int64()).take(doc), pa.array(ties, pa.int64()).take(doc), pa.array(unit, pa.int32()), pa.array(h), pa.array(several), pa.array(salt, pa.int32())]
            whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "unit", "h", "several", "salt"])
            yield from (whole.slice(k, OUT_ROWS) for k in range(0, whole.num_rows, OUT_ROWS))

    return mapped(_keyed(docs), run, "doc_id long, tie long, unit int, h long, several boolean, salt int")


def hashes_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Something to deal by."""
    x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(32)


def later_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, tie`` of the documents whose whole text an earlier one has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), F.md5(whole_text().cast("binary")).alias("d")).distinct()
    place = F.struct("doc_id", "tie")
    first = rows.groupBy("d").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join deals both sides anew and adaptive execution can split a text that very many documents have
    first = stored(first.select("d", "first"), "first-texts")
    return stored(rows.join(first, "d").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "tie"), "later-copies")


def run_rows(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``doc_id, tie, unit, hi, lo`` of the runs whose chosen gram stands at several places of the corpus; none of ``copies``."""
    grams = gram_rows(docs).selectExpr("*", "count(1) over (partition by h, salt) as n").where("several or n > 1")
    marks = grams.groupBy("doc_id", "tie").agg(F.collect_set("unit").alias("marks"))
    marks = marks.select(F.col("doc_id").alias("mk"), F.col("tie").alias("mt"), "marks")
    marks = stored(marks.join(copies, F.col("mk").eqNullSafe(F.col("doc_id")) & (F.col("mt") == F.col("tie")), "left_anti"), "marks")
    rows = _keyed(docs)
    rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("mk")) & (F.col("tie") == F.col("mt"))).select("doc_id", "tie", "text", "marks")

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, tie, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = word_hashes(text.as_py())
                at = np.flatnonzero(np.isin(chosen_grams(words)[1], found.values.to_numpy()))
                for k in range(0, len(at), OUT_ROWS):
                    part = at[k : k + OUT_ROWS]
                    d = [_split(xxhash.xxh3_128_intdigest(words[i : i + RUN].tobytes())) for i in part.tolist()]
                    columns = [[doc_id] * len(part), [tie] * len(part), part, [x for x, _ in d], [x for _, x in d]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    return stored_map(rows, made, _UNITS, "runs")[0]


def dedup(docs: DataFrame, unit: str = "run", min_words: int = RUN) -> DataFrame:
    """``docs`` as a struct ``row`` with ``kept`` (text, n_units, n_removed, removed_spans).

    Spans are written ``start-end`` in code points of the original text, joined by commas. ``min_words`` is for lines
    and paragraphs; a run has ``RUN`` words.
    """
    sep = SEPARATORS.get(unit)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<text: string, n_units: bigint, n_removed: bigint, removed_spans: string>")
    def cut(text: pa.Array, removed: pa.Array) -> pa.Array:
        rows = []
        for t, gone in zip(text, removed):
            at = gone.as_py() or []
            rows.append(without_units(t.as_py(), at, sep) if sep else without_runs(t.as_py(), at))
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["text", "n_units", "n_removed", "removed_spans"])

    if sep:
        gone = repeats(unit_rows(docs, unit, min_words))
    else:
        copies = later_copies(docs)
        gone = repeats(run_rows(docs, copies), RUN).unionByName(copies.withColumn("removed", F.array(*[F.lit(x) for x in WHOLE])))
    gone = stored(gone.select(F.col("doc_id").alias("gk"), F.col("tie").alias("gh"), "removed"), "repeats")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64(whole_text()).alias("h"))
    both = rows.join(gone, F.col("k").eqNullSafe(F.col("gk")) & (F.col("h") == F.col("gh")), "left")
    return both.select("row", cut(F.coalesce("row.text", F.lit("")), "removed").alias("kept"))


def dedup_documents(docs: DataFrame, unit: str = "run", min_words: int = RUN) -> DataFrame:
    """The documents with their later repeats removed, ``n_chars`` (where there is one) recounted; all rows stay."""
    out = dedup(docs, unit, min_words)
    row = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.when(F.col("row.text").isNotNull(), F.col("kept.text"))}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.col("kept.n_removed") > 0, F.length("kept.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[row[c].alias(c) for c in docs.columns])
