"""Lexical scores of texts for many queries in one job.

Query terms are joined before anything is grouped, so only postings that some query asks for are shuffled, by document:
what a document scores for each query is then summed where its postings are. Terms are counted first, and broadcast only
up to ``MOST_TERMS``; beyond that they are joined by token. Corpus figures (count, average length, document frequency)
always cover the whole corpus, filtered or not. Rankings of the k best go by an index (``postings``), made for the call or given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import postings as index
from tamarisk.plans.lineage import fresh_folder

DIGITS = 8
#: So many rows of query terms at most are broadcast.
MOST_TERMS = 200_000


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query, ties by item, with ``rank`` from 1."""
    if k < 1:
        raise ValueError("k must be positive")
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, tokenize=T.tokens) -> DataFrame:
    """``query_id, token, qtf`` from ``query_id, text``."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _near(terms: DataFrame, n: int) -> DataFrame:
    return F.broadcast(terms) if n <= MOST_TERMS else terms


def postings(corpus: DataFrame, tokenize=T.tokens) -> DataFrame:
    """``doc_id, token, tf, length`` of all tokens of ``doc_id, text``."""
    rows = corpus.select("doc_id", tokenize(F.col("text")).alias("toks"))
    rows = rows.select("doc_id", T.once(F.size("toks")).alias("length"), "toks").select("doc_id", "length", F.explode("toks").alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, tokenize=T.tokens, eligible: DataFrame | None = None, zeros: bool = False) -> DataFrame:
    """``query_id, doc_id, score``, rounded so that engines agree on ties.

    ``eligible`` (``doc_id``) restricts what is returned, not the statistics. With ``zeros`` every query has a score
    for every eligible document; a stated query set against all rows is then the size of the result itself.
    """
    terms = query_terms(queries, tokenize)
    n_terms = terms.count()
    post = _weighted(corpus, terms, n_terms, k1, b, tokenize, eligible)
    scored = post.join(_near(terms, n_terms), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qtf")), DIGITS).alias("score"))
    if not zeros:
        return scored
    every = corpus.select("doc_id") if eligible is None else corpus.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
    return queries.select("query_id").crossJoin(every).join(scored, ["query_id", "doc_id"], "left").fillna(0.0, ["score"])


def _weighted(corpus: DataFrame, terms: DataFrame, n_terms: int, k1: float, b: float, tokenize, eligible: DataFrame | None) -> DataFrame:
    """``doc_id, token, weight`` of the tokens that are asked for; a document's rows lie in one partition."""
    if not (k1 > 0 and 0 <= b <= 1):
        raise ValueError("k1 must be positive and b between 0 and 1")
    toks = corpus.select("doc_id", tokenize(F.col("text")).alias("toks")).select("doc_id", "toks", T.once(F.greatest(F.size("toks"), F.lit(0))).alias("length"))
    figures = toks.agg(F.count("*").alias("n"), (F.sum("length") / F.greatest(F.count("*"), F.lit(1))).alias("avg")).first()
    n, avg = figures["n"], max(figures["avg"] or 0.0, 1.0)
    asked = _near(terms.select("token").distinct(), n_terms)
    found = toks.select("doc_id", "length", F.explode("toks").alias("token")).join(asked, "token").repartition("doc_id")
    post = found.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = _near(post.groupBy("token").agg(F.count("*").alias("df")), n_terms)
    if eligible is not None:
        post = post.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / avg))
    return post.join(df, "token").select("doc_id", "token", weight.alias("weight"))


def indexed(corpus: DataFrame, k1: float = 1.2, b: float = 0.75, tokenize=T.tokens) -> index.Index:
    """An index of ``doc_id, text`` that goes when the application ends."""
    return index.build(corpus, fresh_folder(corpus.sparkSession, "index"), k1, b, tokenize)


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, tokenize=T.tokens, eligible: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k best documents of each query."""
    if k < 1:
        raise ValueError("k must be positive")
    return index.bm25_top_k(indexed(corpus, k1, b, tokenize), queries, k, tokenize, eligible)


def jaccard_top_k(corpus: DataFrame, queries: DataFrame, k: int, tokenize=T.tokens) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k documents most alike as sets of tokens."""
    if k < 1:
        raise ValueError("k must be positive")
    return index.jaccard_top_k(indexed(corpus, tokenize=tokenize), queries, k, tokenize)


def jaccard(corpus: DataFrame, queries: DataFrame, tokenize=T.tokens) -> DataFrame:
    """``query_id, doc_id, score`` of the pairs with a common token: shared distinct tokens over all of both."""
    q = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("toks"))
    terms = q.select("query_id", T.once(F.size("toks")).alias("nq"), "toks").select("query_id", "nq", F.explode("toks").alias("token"))
    d = corpus.select("doc_id", F.array_distinct(tokenize(F.col("text"))).alias("toks"))
    d = d.select("doc_id", T.once(F.size("toks")).alias("nd"), "toks").select("doc_id", "nd", F.explode("toks").alias("token"))
    pairs = d.join(_near(terms, terms.count()), "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("i"), F.first("nq").alias("nq"), F.first("nd").alias("nd"))
    return pairs.select("query_id", "doc_id", F.round(F.col("i") / (F.col("nq") + F.col("nd") - F.col("i")), DIGITS).alias("score"))


def overlap_score(query: Column, passage: Column) -> Column:
    """Number of distinct query terms that a passage has: the default scorer of reranking and extraction."""
    lower = lambda c: T.words(F.lower(c))
    return F.size(F.array_intersect(lower(query), lower(passage)))
