"""From ranked chunks to checked context: provenance, blocks, budgets, citations and the rules of abstention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions that ask for advice or for the present state of the law, and names of jurisdictions.
ADVICE_EN = r"(?i)\b(?:should\s+(?:i|we)|do\s+i\s+need\s+to|can\s+i\s+sue|may\s+i\s+(?:sign|pay))\b"
ADVICE_AR = r"هل\s+(?:يجب|ينبغي)|هل\s+أ(?:وقع|دفع|قاضي|رفع\s+دعوى)"
CURRENT = r"(?i)\b(?:current|currently|latest|in\s+force|valid\s+today|up[- ]to[- ]date)\b|ساري|نافذ|حالي|الأحدث|آخر\s+نسخة"
JURISDICTIONS = {
    "saudi arabia": "SA", "saudi": "SA", "السعودية": "SA", "المملكة العربية السعودية": "SA", "egypt": "EG", "egyptian": "EG",
    "مصر": "EG", "مصري": "EG", "uae": "AE", "united arab emirates": "AE", "الإمارات": "AE",
}


def provenance(ranked: DataFrame, chunk_units: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, doc_id, unit_id, ordinal, rank, chunks``: each unit once, with its best rank and its chunks.

    Chunks that name a unit that isn't there are errors, found by ``missing_units``.
    """
    rows = ranked.join(chunk_units, "chunk_id").join(units, "unit_id")
    return rows.groupBy("query_id", "doc_id", "unit_id").agg(F.first("ordinal").alias("ordinal"), F.min("rank").alias("rank"), F.array_sort(F.collect_set("chunk_id")).alias("chunks"))


def missing_units(chunk_units: DataFrame, units: DataFrame) -> DataFrame:
    return chunk_units.join(units, "unit_id", "left_anti")


def blocks(units: DataFrame, by: list[str], ordinal: str = "ordinal", heading: str | None = None) -> DataFrame:
    """``block`` numbers runs of units of a group whose ordinals follow each other (and whose heading stays)."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    joins = F.col(ordinal) == F.lag(ordinal).over(w) + 1
    if heading:
        joins &= F.col(heading).eqNullSafe(F.lag(heading).over(w))
    rows = units.withColumn("_new", F.when(joins, 0).otherwise(1))
    return rows.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def within_budget(units: DataFrame, by: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """``admitted``: units taken whole, in order, while they fit; a later smaller one may fit where a greater didn't.

    A running sum can't tell, so each group is folded in order. A group is one query's ranking, of bounded depth.
    """
    fields = [f for f in units.schema.fields if f.name != "admitted"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, took = budget, []
        pdf = pdf.sort_values(order, kind="stable")
        for c in pdf[cost]:
            fits = c <= left
            left -= int(c) if fits else 0
            took.append(bool(fits))
        return pdf.assign(admitted=took)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", admitted boolean"
    return units.groupBy(by).applyInPandas(fold, schema)


def verified_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, quote, status, chunk_id``: valid if the non-blank quote is part of a chunk of the evidence it names.

    Of several chunks the one of least rank, then id, counts.
    """
    rows = citations.join(evidence, "evidence_id", "left")
    inside = F.col("text").isNotNull() & (F.trim("quote") != "") & F.contains("text", "quote")
    best = F.min(F.when(inside, F.struct("rank", "chunk_id")))
    out = rows.groupBy("claim_id", "evidence_id", "quote").agg(best.alias("best"), F.max(F.col("text").isNotNull().cast("int")).alias("known"))
    status = F.when(F.col("known") == 0, "unknown_evidence").when(F.trim("quote") == "", "blank_quote").when(F.col("best").isNull(), "not_in_evidence").otherwise("valid")
    return out.select("claim_id", "evidence_id", "quote", status.alias("status"), F.col("best.chunk_id").alias("chunk_id"))


def verified_drafts(drafts: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """``draft_id, accepted``: every claim is in the answer and has a valid citation, and no citation is invalid."""
    each = claims.join(citations, "claim_id", "left").groupBy("draft_id", "claim_id", "claim").agg(
        F.coalesce(F.bool_or(F.col("status") == "valid"), F.lit(False)).alias("cited"), F.coalesce(F.bool_or(F.col("status") != "valid"), F.lit(False)).alias("broken")
    )
    joined = drafts.join(each, "draft_id", "left")
    ok = F.col("cited") & ~F.col("broken") & F.contains("answer", "claim")
    return joined.groupBy("draft_id").agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("accepted"))


def requested_jurisdictions(query: Column) -> Column:
    marks = [F.when(F.contains(F.lower(query), F.lit(k)), F.lit(v)) for k, v in JURISDICTIONS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*marks))))


def answerability(
    query: Column, allowed: list[str], evidence: Column, confidence: Column, least: float = 0.0, status_known: Column | None = None, conflicting: Column | None = None,
    superseded: Column | None = None, active: str | None = None, context: Column | None = None, required: bool = False,
) -> Column:
    """The first reason that holds against answering, or null.

    ``active`` is the jurisdiction served (of a single allowed one, that); ``context`` an array of those that the evidence
    names: several, or several asked for, are ambiguous, and so is none served where one is ``required``.
    """
    no = F.lit(False)
    active = active or (allowed[0] if len(allowed) == 1 else None)
    asked = requested_jurisdictions(query)
    one = F.get(asked, F.lit(0))
    known = F.array(*[F.lit(x) for x in sorted(set(JURISDICTIONS.values()))])
    plain = F.coalesce(context if context is not None else F.lit(None), F.array().cast("array<string>"))
    of = F.array_distinct(F.transform(plain, lambda x: F.when(F.array_contains(known, F.upper(x)), F.upper(x)).otherwise(x)))
    ambiguous = (F.size(of) > 1) | (F.size(asked) > 1) | F.lit(required and active is None)
    elsewhere = (F.size(of) == 1) & (F.get(of, F.lit(0)) != F.lit(active) if active else F.lit(True))
    outside = one.isNotNull() & (((one != F.lit(active)) if active else F.lit(True)) | (~one.isin(*allowed) if allowed else no))
    return (
        F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "requested_info_not_found")
        .when(query.rlike(ADVICE_EN) | query.rlike(ADVICE_AR), "personalized_legal_advice")
        .when(ambiguous, "jurisdiction_ambiguous")
        .when(elsewhere | outside, "jurisdiction_mismatch")
        .when(conflicting if conflicting is not None else no, "conflicting_evidence")
        .when(superseded if superseded is not None else no, "superseded_source")
        .when(query.rlike(CURRENT) & ~(status_known if status_known is not None else no), "currentness_unverified")
        .when(F.coalesce(evidence, F.lit(0)) == 0, "no_context")
        .when(confidence < least, "low_retrieval_confidence")
    )


def quote_registry(units: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """``quote_ref`` Q001.. of a group's distinct quotes in order of their first place."""
    first = Window.partitionBy(by, text).orderBy(*order)
    rows = units.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("quote_ref", F.concat(F.lit("Q"), F.lpad(n.cast("string"), 3, "0")))
