"""The whole way from questions to checked answers as one DataFrame program, for many questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.operators import dense, fusion, grounding, lexical, postings
from tamarisk.plans.lineage import rewritten


@dataclass(frozen=True)
class Settings:
    depth: int = 50
    dense_weight: float = 0.25
    serve: int = 8
    budget: int = 4000
    sentences: int = 2
    jurisdictions: tuple[str, ...] = ("SA",)
    #: Size of the vectors that ``dense_ranking`` makes where no encoder is given.
    dimension: int = 64


def dense_ranking(corpus: DataFrame, queries: DataFrame, k: int, encoder=None, dimension: int = 64) -> DataFrame:
    """``query_id, doc_id, score, rank`` of texts by any encoder's vectors; hashed words where none is given."""
    encoder = encoder or dense.hashed_encoder(dimension)
    docs = dense.encoded(corpus.select(F.col("doc_id").alias("id"), "text"), encoder, dimension)
    asked = dense.encoded(queries.select(F.col("query_id").alias("id"), "text"), encoder, dimension)
    return dense.dense_top_k(docs, asked, k)


def retrieved(corpus: DataFrame, queries: DataFrame, settings: Settings = Settings(), encoder=None, index: postings.Index | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """A lexical and a dense ranking fused and reranked by shared terms: ``query_id, doc_id, provenance, score, rerank_score, rank``.

    ``sparse`` is a BM25 ranking of the corpus that is there already, of ``settings.depth`` places at least; or else ``index``, of the same corpus, is asked; without
    either an index is built for the call.
    """
    if sparse is None:
        sparse = postings.bm25_top_k(index or lexical.indexed(corpus), queries, settings.depth)
    second = dense_ranking(corpus, queries, settings.depth, encoder, settings.dimension)
    fused = fusion.reciprocal_rank_fusion(sparse, second, 1.0, settings.dense_weight, depth=settings.depth)
    # a few rows a query: written, so that the join knows it and the corpus stays where it is
    texts = rewritten(fused).join(corpus.select("doc_id", "text"), "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id")
    scored = texts.withColumn("rerank_score", lexical.overlap_score(F.col("query"), F.col("text")).cast("long")).select("doc_id", *[c for c in fused.columns if c != "doc_id"], "rerank_score")
    return fusion.reranked(scored, serve=settings.serve).drop("rank").withColumnRenamed("new_rank", "rank")


def answers(corpus: DataFrame, queries: DataFrame, settings: Settings = Settings(), encoder=None, index: postings.Index | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """``query_id, outcome, answer, citations`` of every question: refused by a rule, abstained, or answered with lines
    that were found word by word in the documents they cite."""
    ranked = retrieved(corpus, queries, settings, encoder, index, sparse).select("query_id", "doc_id", "rank")
    cost = corpus.select("doc_id", F.length("text").cast("long").alias("cost"))
    # a few rows a question, read by all that follows
    held = rewritten(grounding.within_budget(ranked.join(cost, "doc_id"), "query_id", ["rank", "doc_id"], "cost", settings.budget).where("admitted"))
    lines = corpus.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    found = held.join(lines, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id")
    found = found.withColumn("shared", lexical.overlap_score(F.col("query"), F.col("line"))).where("shared > 0 and trim(line) != ''")
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), "rank", "doc_id", "place")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= settings.sentences)
    cites = rewritten(best.select(F.concat_ws("/", "query_id", "n").alias("claim_id"), "query_id", "n", F.col("doc_id").alias("evidence_id"), F.col("line").alias("quote")))
    evidence = corpus.select(F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("chunk_id"), F.lit(1).alias("rank"), "text")
    checked = grounding.verified_citations(cites.select("claim_id", "evidence_id", "quote"), evidence.join(cites.select("evidence_id").distinct(), "evidence_id", "left_semi"))
    good = cites.join(checked.where("status = 'valid'").select("claim_id"), "claim_id", "left_semi")
    made = good.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "quote", "evidence_id"))).alias("c"))
    size = held.groupBy("query_id").agg(F.count("*").alias("evidence"))
    rows = queries.join(size, "query_id", "left").join(made, "query_id", "left")
    reason = grounding.answerability(F.col("text"), list(settings.jurisdictions), F.coalesce("evidence", F.lit(0)), F.lit(1.0))
    outcome = F.coalesce(reason, F.when(F.col("c").isNull(), "abstained").otherwise("answered"))
    shown = outcome == "answered"
    return rows.select(
        "query_id", outcome.alias("outcome"), F.when(shown, F.array_join(F.transform("c", lambda x: x["quote"]), "\n")).alias("answer"),
        F.when(shown, F.array_join(F.transform("c", lambda x: x["evidence_id"].cast("string")), ",")).alias("citations"),
    )
