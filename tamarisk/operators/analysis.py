"""Comparisons of systems and variants, integrity of structures, and small judgements on texts and pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators.quality import IDENTIFIER_MARKS
from tamarisk.plans.lineage import cut


def robustness(scores: DataFrame, intent: str, variant: str, label: str, value: str) -> DataFrame:
    """Per label of a variant: pairs, mean of base, of variant, of base - variant, and whether the sample is small (< 10).

    A base is a row without a variant id; every variant is held against its intent's base.
    """
    base = scores.where(F.col(variant).isNull()).select(intent, F.col(value).alias("base"))
    rows = scores.where(F.col(variant).isNotNull()).join(base, intent)
    return rows.groupBy(label).agg(
        F.count("*").alias("pairs"), F.round(F.avg("base"), 8).alias("base"), F.round(F.avg(value), 8).alias("variant"),
        F.round(F.avg(F.col("base") - F.col(value)), 8).alias("delta"), (F.count("*") < 10).alias("small_sample"),
    )


def ranking_parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: compared places of two rankings, those with different documents, and the greatest score difference."""
    both = a.select("query_id", "rank", F.col("doc_id").alias("x"), F.col("score").alias("s")).join(b.select("query_id", "rank", F.col("doc_id").alias("y"), F.col("score").alias("t")), ["query_id", "rank"], "full_outer")
    gap = F.abs(F.col("s") - F.col("t"))
    return both.agg(F.count("*").alias("places"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"), F.coalesce(F.round(F.max(gap), 10), F.lit(0.0)).alias("largest_gap"), F.coalesce(F.bool_and(gap <= tolerance), F.lit(True)).alias("within"))


def grid_search(fused: DataFrame, measured: str, guard: str, least: float) -> DataFrame:
    """From ``weight`` and two measures: the weight with the greatest ``measured`` whose ``guard`` is at least ``least``; ties take the lower."""
    ok = fused.where(F.col(guard) >= least)
    return ok.orderBy(F.desc(measured), "weight").limit(1)


def score_distribution(frame: DataFrame, by: str, column: str) -> DataFrame:
    near = lambda p: F.expr(f"percentile_disc({p}) within group (order by `{column}`)")
    return frame.groupBy(by).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.round(F.avg(column), 8).alias("mean"), near(0.5).alias("p50"), near(0.95).alias("p95"))


def split_diagnostics(frame: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """``key, total, crossing`` for each key column: values seen, and seen in more than one split."""
    rows = frame.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys])).alias("x")).select(split, "x.*")
    return rows.groupBy("key", "v").agg(F.count_distinct(split).alias("s")).groupBy("key").agg(F.count("*").alias("total"), F.count_if(F.col("s") > 1).alias("crossing"))


def balance(frame: DataFrame, row: str, column: str) -> DataFrame:
    """``row, column, n, rate`` (share of the row's total, six digits)."""
    n = F.count("*").alias("n")
    rows = frame.groupBy(row, column).agg(n)
    return rows.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(row)), 6))


def set_digest(frame: DataFrame, by: str, key: str) -> DataFrame:
    """``by, n, digest``: sha-256 of a group's sorted ids, each group's hashed in slices so that no list grows with it.

    Slices hold the ids of one digest prefix; the digest of a group is that of its slices' digests in order.
    """
    ids = frame.select(by, F.col(key).cast("string").alias("k")).distinct()
    part = F.substring(F.sha2("k", 256), 1, 2)
    slices = ids.groupBy(by, part.alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ",")
    return slices.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b."""
    left = a.select(key).distinct().withColumn("a", F.lit(1))
    right = b.select(key).distinct().withColumn("b", F.lit(1))
    return left.join(right, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def pairwise_order(frame: DataFrame, by: str, wanted: str, got: str) -> DataFrame:
    """``by, comparable, concordant, accuracy`` over pairs of a page's blocks with different wanted places; 1.0 if none.

    Pages bound the pairs.
    """
    x = frame.select(by, F.col(wanted).alias("w1"), F.col(got).alias("g1"))
    y = frame.select(by, F.col(wanted).alias("w2"), F.col(got).alias("g2"))
    pairs = x.join(y, by).where("w1 < w2 and g1 != g2").groupBy(by).agg(F.count("*").alias("comparable"), F.count_if(F.col("g1") < F.col("g2")).alias("concordant"))
    out = frame.select(by).distinct().join(pairs, by, "left").fillna(0, ["comparable", "concordant"])
    return out.withColumn("accuracy", F.when(F.col("comparable") == 0, 1.0).otherwise(F.round(F.col("concordant") / F.col("comparable"), 8)))


def multiset_overlap(a: DataFrame, b: DataFrame, by: str, token: str) -> DataFrame:
    """``by, shared``: the sum over tokens of the smaller of both counts."""
    x = a.groupBy(by, token).agg(F.count("*").alias("n"))
    y = b.groupBy(by, token).agg(F.count("*").alias("m"))
    return x.join(y, [by, token]).groupBy(by).agg(F.sum(F.least("n", "m")).alias("shared"))


def ordering_violations(frame: DataFrame, by: list[str], rank: str, ordinal: str) -> DataFrame:
    """``by, violated``: whether the ordinal falls anywhere while the rank rises."""
    w = Window.partitionBy(*by).orderBy(rank, ordinal)
    return frame.withColumn("_p", F.lag(ordinal).over(w)).groupBy(*by).agg(F.coalesce(F.bool_or(F.col(ordinal) < F.col("_p")), F.lit(False)).alias("violated"))


def tree(units: DataFrame, doc: str, section: str, unit: str) -> DataFrame:
    """``node_id, parent_id, kind`` of documents, their sections and their units."""
    node = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    nothing = F.lit(None).cast("string")
    docs = units.select(node(doc).alias("node_id"), nothing.alias("parent_id"), F.lit("document").alias("kind")).distinct()
    sections = units.select(node(doc, section).alias("node_id"), node(doc).alias("parent_id"), F.lit("section").alias("kind")).distinct()
    leaves = units.select(node(doc, section, unit).alias("node_id"), node(doc, section).alias("parent_id"), F.lit("unit").alias("kind")).distinct()
    return docs.unionByName(sections).unionByName(leaves)


def tree_faults(nodes: DataFrame) -> DataFrame:
    """``node_id, fault``: orphans, whose parent isn't there, and nodes that reach no root.

    Steps double each round (where a node's step leads, that one's step is taken too) until every walk has ended or is
    longer than there are nodes, which only a cycle can make it.
    """
    known = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    orphans = nodes.where("parent_id is not null").join(known, "parent_id", "left_anti").select("node_id", F.lit("orphan").alias("fault"))
    up = cut(nodes.where("parent_id is not null").join(known, "parent_id", "left_semi").select("node_id", F.col("parent_id").alias("at")))
    reach, n = 1, nodes.count()
    while reach <= n and not up.isEmpty():
        up = cut(up.alias("x").join(up.alias("y"), F.col("x.at") == F.col("y.node_id")).select(F.col("x.node_id").alias("node_id"), F.col("y.at").alias("at")))
        reach *= 2
    return orphans.unionByName(up.select("node_id", F.lit("cycle").alias("fault")).distinct())


def page_route(text_length: Column, images: Column, suspicious: Column, few: int = 5, short: int = 80) -> Column:
    """Which reader a page needs: ocr, mixed or embedded."""
    return F.when((text_length < few) & (images > 0), "ocr").when(suspicious | (text_length < short) | (images > 0), "mixed").otherwise("embedded")


def scope_matches(scope: Column, title: Column) -> Column:
    """Whether both share a token of letters and digits."""
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+|[؀-ۿ]+"), F.lit(0))
    return F.arrays_overlap(toks(scope), toks(title))


def separators_kept(text: Column, normal: Column) -> Column:
    """Whether separators inside identifiers (a digit on a side) are the same before and after normalising."""
    found = lambda c: F.regexp_extract_all(c, F.lit(IDENTIFIER_MARKS), F.lit(0))
    return found(text) == found(normal)


def gram_overlap(a: Column, b: Column, n: int = 4) -> Column:
    """The share of a's token n-grams that b has."""
    x, y = T.shingles(T.words(F.lower(a)), n), T.shingles(T.words(F.lower(b)), n)
    return T.share(F.size(F.array_intersect(x, y)), F.size(x))


#: Ways of disturbing a text at the first place they apply to; null where there's none.
def perturbations(text: Column) -> dict[str, Column]:
    put = lambda old, new: F.when(F.instr(text, old) > 0, F.overlay(text, F.lit(new), F.instr(text, old), F.lit(len(old))))
    return {
        "alef": put("أ", "ا"), "ya": put("ى", "ي"), "ta": put("ة", "ه"), "digit": put("١", "1"), "tatweel": F.when(F.length(text) > 1, F.overlay(text, F.concat(F.substring(text, 1, 1), F.lit("ـ")), F.lit(1), F.lit(1))),
        "double_space": put(" ", "  "), "comma": put("،", ","), "question": put("؟", "?"), "newline": put(" ", "\n"), "bom": F.when(F.length(text) > 0, F.concat(F.lit("﻿"), text)),
    }


def resolved_span(text: str, piece: str, occurrence: int | None = None) -> tuple[int, int, str]:
    """(start, end, status) of a piece in a text, overlapping occurrences counted from 0.

    Unique pieces are found whatever occurrence is named (then corrected); several need a right one.
    """
    starts = [m.start() for m in re.finditer(f"(?={re.escape(piece)})", text)] if piece else []
    if not starts:
        return -1, -1, "missing"
    if occurrence is not None and 0 <= occurrence < len(starts):
        return starts[occurrence], starts[occurrence] + len(piece), "exact"
    if len(starts) == 1:
        return starts[0], starts[0] + len(piece), "exact" if occurrence is None else "corrected"
    return -1, -1, "ambiguous"


def resolved_spans(frame: DataFrame, text: str, piece: str) -> DataFrame:
    def find(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([resolved_span(a or "", b or "") for a, b in zip(t, p)], columns=["start", "end", "status"])

    find.__annotations__ = {"t": pd.Series, "p": pd.Series, "return": pd.DataFrame}
    return frame.withColumn("span", F.pandas_udf(find, "start int, end int, status string")(text, piece))


def upload_segments(text: str, limit: int = 18_000, most: int = 5) -> list[tuple[int, int]]:
    """Paragraph-wise segments of at most ``limit`` characters, broken at the last space that fits.

    ``most`` is the upload's limit: longer texts are refused with an error, never shortened.
    """
    out, at = [], 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", " "):
                cut = text.rfind(mark, at + 1, end)
                if cut > at:
                    end = cut
                    break
        if text[at:end].strip():
            out.append((at, end))
        at = end
    if len(out) > most:
        raise ValueError(f"the text has more than {most} segments of {limit} characters")
    return out


def agreed(first: Column, second: Column, first_confidence: Column, second_confidence: Column) -> tuple[Column, Column]:
    """Two passes' common verdict, or UNCERTAIN, with the lower confidence."""
    return F.when(first.eqNullSafe(second), first).otherwise("UNCERTAIN"), F.least(first_confidence, second_confidence)
