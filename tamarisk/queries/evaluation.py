"""Measures: rankings of embeddings against their labels, and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.operators import metrics
from tamarisk.queries.retrieval import _BM25, _DENSE, _JACCARD, _RRF, _TOP, bm25_ranking, dense_ranking, fused, jaccard_ranking
from tamarisk.queries.tables import QUERY_ROWS, corpus, table, vectors
from tamarisk.registry import query


def label_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a query's label are relevant, those with even ids more so."""
    asked, members = label_groups(spark, sf_dir)
    return asked.join(members, "group").select("query_id", "doc_id", "grade")


def label_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same unlisted: queries' labels as ``query_id, group``, and ``group, doc_id, grade`` of all vectors."""
    v = vectors(spark, sf_dir)
    asked = v.where(F.col("id") % QUERY_ROWS == 0).select(F.col("id").alias("query_id"), F.col("label").alias("group"))
    return asked, v.select(F.col("label").alias("group"), F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("grade"))


def gold_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages' gold: the documents that BM25's and Jaccard's first places agree on."""
    a, b = bm25_ranking(spark, sf_dir, 3), jaccard_ranking(spark, sf_dir, 10)
    return a.join(b.select("query_id", "doc_id"), ["query_id", "doc_id"]).select("query_id", "doc_id", F.lit(1).alias("grade"))


_RANKED = f"ranked AS (SELECT query_id, doc_id, {_TOP} AS rank FROM dense QUALIFY rank <= 10)"
_QRELS = "qrels AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN b.vec_id % 2 = 0 THEN 2 ELSE 1 END AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0)"
_METRICS = f"""{_DENSE.strip()}, {_RANKED}, {_QRELS},
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels),
norm AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN place <= 10 THEN (2 ** grade - 1) / log2(place + 1) ELSE 0 END) AS idcg, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS binary_idcg FROM ideal GROUP BY 1),
hits AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, sum(1 / log2(rank + 1)) AS binary_dcg FROM ranked JOIN qrels USING (query_id, doc_id) GROUP BY 1),
metrics AS (
  SELECT n.query_id, round(coalesce(hits, 0) / relevant, 8) AS recall, round(coalesce(hits, 0) / 10, 8) AS precision,
    coalesce(round(1 / first, 8), 0) AS mrr, coalesce(round(dcg / idcg, 8), 0) AS ndcg, coalesce(round(binary_dcg / binary_idcg, 8), 0) AS binary_ndcg
  FROM norm n LEFT JOIN hits h USING (query_id)
)"""


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.measures(metrics.judged_by_group(dense_ranking(spark, sf_dir, 10), *label_groups(spark, sf_dir), 10), 10)


@query(f"WITH {_METRICS} SELECT round(avg(recall), 8) AS recall, round(avg(precision), 8) AS precision, round(avg(mrr), 8) AS mrr, round(avg(ndcg), 8) AS ndcg FROM metrics")
def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_mrr_ndcg(spark, sf_dir).agg(*[F.round(F.avg(c), 8).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


@query(f"""WITH {_DENSE}, {_RANKED}, {_QRELS}, g AS (SELECT query_id, doc_id % 3 AS group_id, doc_id FROM qrels),
each AS (SELECT g.query_id, group_id, max(CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END) AS hit FROM g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY 1, 2)
SELECT query_id, min(hit) AS complete FROM each GROUP BY 1""")
def complete_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, members = label_groups(spark, sf_dir)
    return metrics.complete_by_group(dense_ranking(spark, sf_dir, 10), asked, members.select("group", (F.col("doc_id") % 3).alias("group_id"), "doc_id"), 10)


@query("""SELECT * FROM (
  SELECT 'lang' AS dimension, lang AS label, count(*) AS n, round(avg(n_chars), 8) AS mean FROM documents GROUP BY lang
  UNION ALL SELECT 'source', source, count(*), round(avg(n_chars), 8) FROM documents GROUP BY source
  UNION ALL SELECT 'length', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END, count(*), round(avg(n_chars), 8) FROM documents GROUP BY 2)""")
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long")
    return metrics.slice_means(table(spark, sf_dir, "documents").withColumn("length", length), ["lang", "source", "length"], "n_chars")


@query("SELECT count(*) FILTER (quality > toxic) AS wins, count(*) FILTER (quality = toxic) AS ties, count(*) FILTER (quality < toxic) AS losses, round(avg(quality - toxic), 8) AS delta, round((count(*) FILTER (quality > toxic) - count(*) FILTER (quality < toxic)) / count(*), 8) AS rank_biserial FROM labels")
def wins_ties_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.wins_ties_losses(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH c AS (SELECT quality AS l, 1 - toxic AS r FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (l = r) / count(*) AS po FROM c),
pe AS (SELECT sum(x.c * y.c) AS ab FROM (SELECT l AS v, count(*) AS c FROM c GROUP BY 1) x JOIN (SELECT r AS v, count(*) AS c FROM c GROUP BY 1) y USING (v))
SELECT n, round(po, 8) AS observed, round(ab / (n * n), 8) AS expected, round((po - ab / (n * n)) / (1 - ab / (n * n)), 8) AS kappa FROM n, pe""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cohens_kappa(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean")), "quality", "clean")


@query("SELECT count(*) AS n, round(avg(quality), 8) AS before_rate, round(avg(toxic), 8) AS after_rate, round(avg(toxic) - avg(quality), 8) AS difference, count(*) FILTER (quality = 1 AND toxic = 0) AS only_before, count(*) FILTER (quality = 0 AND toxic = 1) AS only_after FROM labels")
def risk_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_difference(table(spark, sf_dir, "labels"), "quality", "toxic")


_SYSTEMS = f"""WITH {_BM25}, {_JACCARD}, a AS (SELECT query_id, doc_id, {_TOP} AS rank FROM bm25 QUALIFY rank <= 10), b AS (SELECT query_id, doc_id, {_TOP} AS rank FROM jaccard QUALIFY rank <= 10),
gold AS (SELECT a.query_id, a.doc_id FROM a JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id WHERE a.rank <= 3)"""


def hit(rankings: DataFrame, qrels: DataFrame, name: str) -> DataFrame:
    found = rankings.select("query_id", "doc_id", F.lit(1).alias("h"))
    return qrels.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.coalesce(F.max("h"), F.lit(0)).alias(name))


@query(_SYSTEMS + """, l AS (SELECT g.query_id, max(CASE WHEN a.rank <= 1 THEN 1 ELSE 0 END) AS x, max(CASE WHEN b.rank <= 1 THEN 1 ELSE 0 END) AS y
  FROM gold g LEFT JOIN a ON a.query_id = g.query_id AND a.doc_id = g.doc_id LEFT JOIN b ON b.query_id = g.query_id AND b.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) FILTER (x = 1 AND y = 1) AS both_found, count(*) FILTER (x = 1 AND y = 0) AS only_first, count(*) FILTER (x = 0 AND y = 1) AS only_second, count(*) FILTER (x = 0 AND y = 0) AS neither FROM l""")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_qrels(spark, sf_dir)
    x = hit(bm25_ranking(spark, sf_dir, 1), gold, "x")
    both = x.join(hit(jaccard_ranking(spark, sf_dir, 1), gold, "y"), "query_id")
    case = lambda a, b: F.count_if((F.col("x") == a) & (F.col("y") == b))
    return both.agg(case(1, 1).alias("both_found"), case(1, 0).alias("only_first"), case(0, 1).alias("only_second"), case(0, 0).alias("neither"))


@query(_RRF.replace("WITH", "WITH", 1) + """, gold AS (SELECT s.query_id, s.doc_id FROM s JOIN d ON s.query_id = d.query_id AND s.doc_id = d.doc_id WHERE s.rank <= 3 AND d.rank <= 10),
l AS (SELECT g.query_id, max(CASE WHEN s.rank <= 1 THEN 1 ELSE 0 END) AS x, max(CASE WHEN r.rank <= 1 THEN 1 ELSE 0 END) AS y
  FROM gold g LEFT JOIN s ON s.query_id = g.query_id AND s.doc_id = g.doc_id LEFT JOIN ranked r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) FILTER (x = 0 AND y = 1) AS rescued, count(*) FILTER (x = 1 AND y = 0) AS damaged FROM l""")
def rescue_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_qrels(spark, sf_dir)
    x = hit(bm25_ranking(spark, sf_dir, 1), gold, "x")
    both = x.join(hit(fused(spark, sf_dir).where("rank <= 1"), gold, "y"), "query_id")
    return both.agg(F.count_if(F.expr("x = 0 and y = 1")).alias("rescued"), F.count_if(F.expr("x = 1 and y = 0")).alias("damaged"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").cast("double"), F.col("toxic").cast("double"))


@query()
def bootstrap_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap(_paired(spark, sf_dir), "lang", "quality", "toxic", "ceil", key="doc_id")


@query()
def bootstrap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap(_paired(spark, sf_dir), "lang", "quality", "toxic", "floor", key="doc_id")


@query()
def bootstrap_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap(_paired(spark, sf_dir), "lang", "quality", "toxic", "linear", key="doc_id")


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = metrics.percentile_nearest
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), nearest("value", 0.5).alias("p50"), nearest("value", 0.95).alias("p95"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor((count(value) - 1) * 0.95) AS INT) + 1] AS p95, median(value) AS p50 FROM events GROUP BY 1")
def latency_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p95 = metrics.percentile_floor(e, ["event_type"], "value", {"p95": 0.95}, lambda n, p: F.floor((n - 1) * p))
    return p95.join(e.groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50")), "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, count(*) AS n, quantile_cont(value, 0.95) AS p95, avg(value) AS mean FROM r WHERE n <= 50 GROUP BY 1")
def latency_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(newest)).where("r <= 50")
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", 0.95).alias("p95"), F.avg("value").alias("mean"))


@query(r"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents)
SELECT lang, count(*) AS docs, CAST(quantile_disc(n, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(n, 0.9) AS DOUBLE) AS p90, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(n, 0.99) AS DOUBLE) AS p99,
  round(avg(CASE WHEN n > 512 THEN 1 ELSE 0 END), 8) AS above_512, round(avg(CASE WHEN n > 1024 THEN 1 ELSE 0 END), 8) AS above_1024, round(avg(CASE WHEN n > 2048 THEN 1 ELSE 0 END), 8) AS above_2048, max(n) AS longest
FROM t GROUP BY lang""")
def token_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.functions import text as T

    rows = corpus(spark, sf_dir).select("lang", F.size(T.tokens(F.col("text"))).alias("n"))
    near = {f"p{int(p * 100)}": metrics.percentile_nearest("n", p) for p in (0.5, 0.9, 0.95, 0.99)}
    over = {f"above_{m}": F.round(F.avg((F.col("n") > m).cast("double")), 8) for m in (512, 1024, 2048)}
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), *[c.alias(k) for k, c in (near | over).items()], F.max("n").cast("long").alias("longest"))




@query()
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_rates(spark, sf_dir).select("conv_id", "turn", "cer")


@query()
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_rates(spark, sf_dir).select("conv_id", "turn", "wer")


def _error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("reference")).join(following, ["conv_id", "turn"])
    return metrics.word_errors(pairs, "reference", "candidate")


@query(_SYSTEMS + """, g AS (SELECT DISTINCT query_id, doc_id FROM gold), p AS (SELECT query_id, doc_id FROM a WHERE rank <= 3),
c AS (SELECT count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM g FULL JOIN p ON g.query_id = p.query_id AND g.doc_id = p.doc_id)
SELECT tp, fp, fn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c""")
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.span_scores(gold_qrels(spark, sf_dir), bm25_ranking(spark, sf_dir, 3), ["query_id", "doc_id"])


@query(f"WITH {_BM25}, top AS (SELECT query_id, doc_id, score, {_TOP} AS rank FROM bm25 QUALIFY rank <= 10), o AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM top), t AS (SELECT max(score) AS threshold FROM o WHERE r = least(n - 1, CAST(floor(n * 0.25) AS BIGINT)) + 1) SELECT count(*) AS n, any_value(threshold) AS threshold, count(*) FILTER (score > threshold) AS kept FROM top, t")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits a gate at the quarter of the sorted scores keeps; only scores above it pass."""
    top = bm25_ranking(spark, sf_dir, 10).select("score")
    place = lambda n, p: F.least(n - 1, F.floor(n * p))
    gate = metrics.percentile_floor(top.withColumn("all", F.lit(1)), ["all"], "score", {"threshold": 0.25}, place)
    return top.crossJoin(gate.select("threshold")).agg(F.count("*").alias("n"), F.first("threshold").alias("threshold"), F.count_if(F.col("score") > F.col("threshold")).alias("kept"))
