"""Splitting texts into chunks whose spans point exactly into the source, in code points, half-open."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.plans.lineage import rewritten

_TOKEN = re.compile(r"\w+|[^\w\s]")
_PARAGRAPH = re.compile(r"\n+")
_SENTENCE = re.compile(r"(?<=[.!?؟؛:])\s+")
WINDOW_OVERLAP = 64


def exact_spans(text: str, target: int = 384, maximum: int = 512) -> list[tuple[int, int, bool]]:
    """(start, end, oversize) of a text's pieces, none of more than ``maximum`` tokens.

    Paragraphs that fit stay whole; others break into sentences, each ending one code point before the next begins, and
    sentences that are still too long into overlapping windows (marked oversize). Neighbours merge while the first has
    fewer than ``target`` tokens and both together fit; windows never do.
    """
    if target < 1 or maximum < target:
        raise ValueError("budgets must be positive, and the target at most the maximum")
    places = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in places]

    def tokens(a: int, b: int) -> int:
        """Tokens of text[a:b]; a token that an end cuts counts with its part inside."""
        lo, hi = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        return hi - lo + (lo > 0 and places[lo - 1][1] > a)

    def pieces():
        at = 0
        for a, b in [*(m.span() for m in _PARAGRAPH.finditer(text)), (len(text), len(text))]:
            if text[at:a].strip():
                if tokens(at, a) <= maximum:
                    yield at, a, False
                else:
                    begins = [at, *(at + m.end() for m in _SENTENCE.finditer(text[at:a]))]
                    for s, e in zip(begins, [*(x - 1 for x in begins[1:]), a]):
                        if text[s:e].strip():
                            yield from windows(s, e)
            at = b

    def windows(s: int, e: int):
        own = [(s + m.start(), s + m.end()) for m in _TOKEN.finditer(text[s:e])]
        if len(own) <= maximum:
            yield s, e, False
            return
        for first in range(0, len(own), max(maximum - WINDOW_OVERLAP, 1)):
            last = min(first + maximum, len(own))
            yield own[first][0], own[last - 1][1], True
            if last == len(own):
                return

    out: list[tuple[int, int, bool]] = []
    for s, e, over in pieces():
        if out and not over and not out[-1][2] and tokens(out[-1][0], out[-1][1]) < target and tokens(out[-1][0], e) <= maximum:
            out[-1] = (out[-1][0], e, False)
        else:
            out.append((s, e, over))
    return out


def split_texts(docs: DataFrame, target: int = 384, maximum: int = 512) -> DataFrame:
    """``doc_id, ordinal, start, end, oversize, text`` of every piece of ``doc_id, text``; null and blank texts have none."""

    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b, "oversize": o} for a, b, o in exact_spans(t or "", target, maximum)])

    cut.__annotations__ = {"s": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(cut, "array<struct<start:int,end:int,oversize:boolean>>")
    rows = docs.select("doc_id", "text", udf("text").alias("spans")).select("doc_id", "text", F.posexplode("spans").alias("ordinal", "s"))
    return rows.select("doc_id", "ordinal", "s.start", "s.end", "s.oversize", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


def fixed_windows(docs: DataFrame, maximum: int = 256, overlap: int = 32) -> DataFrame:
    """``doc_id, window, first, last`` (token places, half-open): windows step by maximum - overlap and stop at the end."""
    step = max(maximum - overlap, 1)
    rows = docs.select("doc_id", T.once(F.size(T.tokens(F.col("text")))).alias("n")).where("n > 0")
    count = F.greatest(F.lit(0), F.ceil((F.col("n") - maximum) / step)).cast("int")
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), count)).alias("window"))
    return rows.select("doc_id", "window", (F.col("window") * step).cast("long").alias("first"), F.least(F.col("window") * step + maximum, F.col("n")).cast("long").alias("last"))


def neighbour_context(chunks: DataFrame, parent: str, order: list[str], text: str, reach: int = 1) -> DataFrame:
    """Each chunk with ``context``: its own text between those of its neighbours of the same parent."""
    w = Window.partitionBy(parent).orderBy(*order).rowsBetween(-reach, reach)
    return chunks.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """The union of ``key, start, end`` intervals; overlapping and touching ones become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def span_overlaps(gold: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Pairs of ``gold_start, gold_end`` and ``start, end`` of one key that share at least one position, with how many."""
    shared = F.least("end", "gold_end") - F.greatest("start", "gold_start")
    return gold.join(chunks, key).withColumn("shared", shared).where("shared > 0")


def span_metrics(overlaps: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Per gold span: recall (share of it that some chunk holds at best) and precision of that chunk."""
    size, gold_size = F.col("end") - F.col("start"), F.col("gold_end") - F.col("gold_start")
    best = overlaps.groupBy(*key).agg(F.round(F.max(F.col("shared") / gold_size), 8).alias("recall"), F.round(F.max(F.col("shared") / size), 8).alias("precision"))
    return gold.select(*key).distinct().join(best, key, "left").fillna(0.0)


def chunk_summary(chunks: DataFrame, doc: str, size: str) -> DataFrame:
    """One row: chunks, per document, mean, median, p95 (place int(n .95) - 1 of the sorted sizes) and greatest size."""
    w = Window.partitionBy(F.lit(1)).orderBy("s")
    # two figures are of documents, the rest of the sizes' histogram: chunks are made once, and only their keys and sizes are written
    chunks = rewritten(chunks.select(F.col(doc).alias("doc"), F.col(size).alias("s")).groupBy("doc", "s").agg(F.count("*").alias("c")))
    sizes = chunks.groupBy("s").agg(F.sum("c").alias("c"))
    n = sizes.agg(F.sum("c").alias("all"), (F.sum(F.col("s") * F.col("c")) / F.sum(F.when(F.col("s").isNotNull(), F.col("c")))).alias("mean"), F.expr("percentile(s, 0.5D, c)").alias("median"), F.max("s").cast("long").alias("longest"))
    n = n.select(F.coalesce("all", F.lit(0)).alias("all"), "mean", "median", "longest").crossJoin(chunks.agg(F.count_distinct("doc").alias("d")))
    sizes = sizes.withColumn("upto", F.sum("c").over(w))
    place = F.greatest(F.floor(F.col("all") * 0.95) - 1, F.lit(0)) + 1
    p95 = sizes.crossJoin(F.broadcast(n)).where(F.col("upto") >= place).agg(F.min("s").cast("long").alias("p95"))
    return n.crossJoin(p95).select(F.col("all").alias("chunks"), F.round(F.col("all") / F.col("d"), 8).alias("per_document"), F.round("mean", 8).alias("mean"), "median", "p95", "longest")
