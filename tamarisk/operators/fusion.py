"""Fusion and reordering of rankings ``query_id, doc_id, rank``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(sparse: DataFrame, dense: DataFrame, sparse_weight: float = 1.0, dense_weight: float = 0.25, constant: int = 60, depth: int = 50, keep: int = 20, rank_first: bool = True) -> DataFrame:
    """``query_id, doc_id, sparse_rank, dense_rank, provenance, score, rank``.

    The score sums weight / (constant + rank) over the rankings that have the document within ``depth``. Ties go by the
    better of both ranks (unless ``rank_first`` is false), then by document.
    """
    key = ["query_id", "doc_id"]
    s = sparse.where(F.col("rank") <= depth).select(*key, F.col("rank").alias("sparse_rank"))
    d = dense.where(F.col("rank") <= depth).select(*key, F.col("rank").alias("dense_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (constant + F.col(c)), F.lit(0.0))
    both = s.join(d, key, "full_outer").withColumn("score", F.round(part("sparse_rank", sparse_weight) + part("dense_rank", dense_weight), 12))
    label = F.when(F.col("dense_rank").isNull(), "sparse-only").when(F.col("sparse_rank").isNull(), "dense-only").otherwise("both")
    ties = [F.least("sparse_rank", "dense_rank")] if rank_first else []
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties, "doc_id")
    return both.withColumn("provenance", label).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def reranked(candidates: DataFrame, score: str = "rerank_score", serve: int = 8, head: int | None = None) -> DataFrame:
    """Candidates by descending new score, ties by prior rank then document, cut to ``serve``.

    With ``head`` only the first so many are reordered and the rest keep their places behind them.
    """
    first = [F.when(F.col("rank") <= head, 0).otherwise(F.col("rank"))] if head else []
    by = F.when(F.col("rank") <= head, F.col(score)) if head else F.col(score)
    order = Window.partitionBy("query_id").orderBy(*first, F.desc(by), "rank", "doc_id")
    return candidates.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= serve)


def parent_best(scored: DataFrame, k: int = 10) -> DataFrame:
    """From ``query_id, parent_id, doc_id, score``: each parent's best child (ties: smaller id), then the k best parents."""
    child = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("n", F.row_number().over(child)).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def provenance_shares(fused: DataFrame) -> DataFrame:
    """``provenance, share`` of the three labels, zero where one doesn't occur."""
    n = F.count("*")
    row = fused.agg(*[F.when(n > 0, F.count_if(F.col("provenance") == p) / n).otherwise(0.0).alias(p) for p in ("both", "sparse-only", "dense-only")])
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*[f"`{c}`" for c in row.columns]))).alias("provenance", "share"))
