"""Compositions for experiments: grids, comparisons, diagnostics of candidates, assembled contexts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import grounding, metrics, scan

METRICS = ("recall", "precision", "mrr", "ndcg")


def lexical_grid(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, policies: tuple[str, ...] = ("raw", "light"), k: int = 10) -> DataFrame:
    """``method, policy, query_id`` and measures of BM25 and of the Jaccard ranking under each normal form.

    Each form is ranked once, so the corpus is scanned for it and no index is made.
    """
    out = []
    for policy in policies:
        found = scan.top_k(corpus, queries, k, lambda t, p=policy: T.tokens(T.normalised(t, p)))
        for method in scan.METHODS:
            rows = metrics.query_metrics(found.where(F.col("method") == method).select("query_id", "doc_id", "rank"), qrels, k)
            out.append(rows.select(F.lit(method).alias("method"), F.lit(policy).alias("policy"), "query_id", *METRICS))
    return reduce(DataFrame.unionByName, out)


def pairwise_systems(scores: DataFrame) -> DataFrame:
    """``a, b, metric, n, wins, ties, losses, delta, rank_biserial`` of every two systems of ``system, query_id, metric, value``.

    Queries that both have count; systems are few.
    """
    x = scores.select(F.col("system").alias("a"), "query_id", "metric", F.col("value").alias("x"))
    y = scores.select(F.col("system").alias("b"), "query_id", "metric", F.col("value").alias("y"))
    both = x.join(y, ["query_id", "metric"]).where("a < b")
    wins, losses, n = F.count_if(F.col("x") > F.col("y")), F.count_if(F.col("x") < F.col("y")), F.count("*")
    return both.groupBy("a", "b", "metric").agg(
        n.alias("n"), wins.alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), losses.alias("losses"),
        F.round(F.avg(F.col("x") - F.col("y")), 8).alias("delta"), F.round((wins - losses) / n, 8).alias("rank_biserial"),
    )


def candidate_diagnostics(fused: DataFrame, base: DataFrame, qrels: DataFrame, k: int = 20, top: int = 10) -> DataFrame:
    """One row: mean candidate recall at k, shares of provenance, and queries that fusing rescued or damaged at ``top``."""
    recall = metrics.query_metrics(fused.select("query_id", "doc_id", "rank"), qrels, k).agg(F.round(F.avg("recall"), 8).alias("candidate_recall"))
    share = lambda p: F.round(F.avg((F.col("provenance") == p).cast("double")), 8).alias(p.replace("-", "_"))
    shares = fused.where(F.col("rank") <= k).agg(*[share(p) for p in ("both", "sparse-only", "dense-only")])
    hit = lambda r, name: r.where(F.col("rank") <= top).join(qrels.where("grade > 0").select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).select("query_id", F.lit(1).alias(name)).distinct()
    asked = qrels.where("grade > 0").select("query_id").distinct()
    both = asked.join(hit(base, "x"), "query_id", "left").join(hit(fused, "y"), "query_id", "left")
    moved = both.agg(F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("rescued"), F.count_if(F.col("x").isNotNull() & F.col("y").isNull()).alias("damaged"))
    return recall.crossJoin(shares).crossJoin(moved)


def relevant_by_provenance(fused: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``provenance, hits, queries``: relevant documents among the first k, by where they came from."""
    good = qrels.where("grade > 0").select("query_id", "doc_id").distinct()
    rows = fused.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"], "left_semi")
    return rows.groupBy("provenance").agg(F.count("*").alias("hits"), F.count_distinct("query_id").alias("queries"))


def rekeyed_chunks(chunks: DataFrame, new_id: Callable[[], Column]) -> DataFrame:
    """``chunk_id, old_id, text, tokens`` under another identifier; tokens here are words between white space."""
    words = F.size(F.filter(F.split(F.trim("text"), r"(?U)\s+"), lambda w: w != ""))
    return chunks.select(new_id().alias("chunk_id"), F.col("chunk_id").alias("old_id"), "text", words.alias("tokens"))


def evaluation_units(units: DataFrame, plain: str, plain_types: tuple[str, ...], structured: tuple[str, ...], fallback: str) -> DataFrame:
    """Units of ``source, document, kind, text``: of the plain source its types; of others the structured types, or where a
    document has none with text, its fallback."""
    has = F.max((F.col("kind").isin(*structured) & (F.trim(F.coalesce("text", F.lit(""))) != "")).cast("int"))
    docs = units.groupBy(F.col("source").alias("_s"), F.col("document").alias("_d")).agg(has.alias("_has"))
    rows = units.join(docs, F.col("source").eqNullSafe(F.col("_s")) & F.col("document").eqNullSafe(F.col("_d")))
    of_plain = (F.col("source") == plain) & F.col("kind").isin(*plain_types)
    of_others = (F.col("source") != plain) & (F.col("kind").isin(*structured) | ((F.col("kind") == fallback) & (F.col("_has") == 0)))
    return rows.where(of_plain | of_others).drop("_s", "_d", "_has")


def returned_evidence(evidence: DataFrame, documents: list) -> DataFrame:
    """The evidence of the chosen documents, in its order; of all if none is chosen."""
    return evidence.where(F.col("doc_id").isin(*documents)) if documents else evidence


def assembled_context(ranked: DataFrame, chunk_units: DataFrame, units: DataFrame, budget: int, cost: str = "cost") -> DataFrame:
    """``query_id, doc_id, unit_id, ordinal, rank, chunks, admitted, block, label``: what a query's answer may draw on.

    Units of the ranked chunks stand once, in order of best rank, document and ordinal, while they fit the budget; those
    admitted form blocks of neighbours and are labelled E001 and so on. Omitted units stay, without block and label.
    """
    found = grounding.provenance(ranked, chunk_units, units).join(units.select("unit_id", cost), "unit_id")
    held = grounding.within_budget(found, "query_id", ["rank", "doc_id", "ordinal", "unit_id"], cost, budget)
    kept = grounding.blocks(held.where("admitted"), ["query_id", "doc_id"])
    first = F.min("rank").over(Window.partitionBy("query_id", "doc_id"))
    kept = kept.withColumn("_first", first)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "doc_id", "ordinal", "unit_id"))
    kept = kept.withColumn("label", F.concat(F.lit("E"), F.lpad(n.cast("string"), 3, "0"))).drop("_first")
    rest = held.where("not admitted").withColumn("block", F.lit(None).cast("long")).withColumn("label", F.lit(None).cast("string"))
    return kept.unionByName(rest).drop(cost)


def quality_record(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with a boolean a check and ``passes``, whether all hold; a check of null fails."""
    out = rows.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    return out.withColumn("passes", reduce(lambda a, b: a & b, [F.col(k) for k in checks], F.lit(True)))


def backing_off(encoder, least: int = 1):
    """An encoder that halves its batch whenever memory doesn't suffice, down to ``least`` texts."""
    def encode(texts: list[str]):
        import numpy as np

        size, out, at = max(least, len(texts)), [], 0
        while at < len(texts):
            try:
                out.append(np.asarray(encoder(texts[at : at + size])))
                at += size
            except MemoryError:
                if size <= least:
                    raise
                size = max(least, size // 2)
        return np.concatenate(out) if out else np.asarray(encoder([]))

    return encode
