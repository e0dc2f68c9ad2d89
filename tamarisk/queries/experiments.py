"""Queries of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import experiments, identity, scan
from tamarisk.plans.lineage import rewritten
from tamarisk.queries.evaluation import gold_qrels
from tamarisk.queries.retrieval import bm25_ranking, fused
from tamarisk.queries.tables import benchmark, corpus, table
from tamarisk.registry import query


@query()
def lexical_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two methods under two normal forms; tests hold them against the single rankings."""
    docs, asked = corpus(spark, sf_dir), benchmark(spark, sf_dir)
    # the gold of gold_qrels, scanned for like the grid's rankings: nothing here needs the session's index
    found = scan.top_k(docs, asked, 10)
    first = found.where("method = 'bm25' and rank <= 3").join(found.where("method = 'jaccard'").select("query_id", "doc_id"), ["query_id", "doc_id"])
    gold = rewritten(first.select("query_id", "doc_id", F.lit(1).alias("grade")))
    rows = experiments.lexical_grid(docs, asked, gold)
    return rows.groupBy("method", "policy").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 8).alias(m) for m in experiments.METRICS])


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS system, l_orderkey AS query_id, 'ndcg' AS metric, l_orderkey % 7 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN l_orderkey % 3 ELSE 0 END AS value FROM lineitem)
SELECT x.system AS a, y.system AS b, x.metric AS metric, count(*) AS n, count(*) FILTER (x.value > y.value) AS wins, count(*) FILTER (x.value = y.value) AS ties, count(*) FILTER (x.value < y.value) AS losses, round(avg(x.value - y.value), 8) AS delta,
  round((count(*) FILTER (x.value > y.value) - count(*) FILTER (x.value < y.value)) / count(*), 8) AS rank_biserial FROM s x JOIN s y ON x.query_id = y.query_id AND x.metric = y.metric AND x.system < y.system GROUP BY 1, 2, 3""")
def pairwise_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("l_orderkey"), F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(s.alias("system"), k.alias("query_id")).distinct()
    value = F.col("query_id") % 7 + F.when(F.col("system") == "A", 1).when(F.col("system") == "N", F.col("query_id") % 3).otherwise(0)
    return experiments.pairwise_systems(rows.select("system", "query_id", F.lit("ndcg").alias("metric"), value.alias("value")))


@query()
def candidate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the deepest rankings first; the others are their beginnings
    found = fused(spark, sf_dir)
    return experiments.candidate_diagnostics(found, bm25_ranking(spark, sf_dir, 20), gold_qrels(spark, sf_dir))


@query()
def relevant_by_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.relevant_by_provenance(fused(spark, sf_dir), gold_qrels(spark, sf_dir))


@query(r"""SELECT 'words:' || substr(sha256('{"policy_hash":"","source_identity":"' || doc_id || '","spans":[{"end":' || length(text) || ',"start":0,"unit_id":"' || doc_id || '"}],"strategy_id":"words"}'), 1, 32) AS chunk_id, doc_id AS old_id, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w != '')) AS tokens FROM documents""")
def rekeyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks under identifiers without a policy, with their words counted."""
    name = F.col("chunk_id").cast("string")
    spans = F.array(F.struct(name.alias("unit_id"), F.lit(0).alias("start"), F.length("text").alias("end")))
    rows = experiments.rekeyed_chunks(corpus(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), lambda: identity.chunk_id(F.lit("words"), name, spans))
    return rows.select("chunk_id", "old_id", F.col("tokens").cast("long").alias("tokens"))


@query("""WITH u AS (SELECT conv_id % 2 AS s, conv_id AS d, turn, role AS kind, text FROM conversations), h AS (SELECT s, d, max(CASE WHEN kind = 'assistant' AND trim(text) != '' THEN 1 ELSE 0 END) AS has FROM u GROUP BY 1, 2)
SELECT d AS conv_id, turn, kind FROM u JOIN h USING (s, d) WHERE (s = 0 AND kind = 'user') OR (s = 1 AND (kind = 'assistant' OR (kind = 'system' AND has = 0)))""")
def evaluation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") % 2).cast("string").alias("source"), F.col("conv_id").alias("document"), "turn", F.col("role").alias("kind"), "text")
    return experiments.evaluation_units(rows, "0", ("user",), ("assistant",), "system").select(F.col("document").alias("conv_id"), "turn", "kind")


@query("SELECT o_orderkey, o_totalprice < 300000 AS cheap, o_orderstatus IN ('O', 'F') AS settled, o_totalprice < 300000 AND o_orderstatus IN ('O', 'F') AS passes FROM orders")
def quality_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = experiments.quality_record(table(spark, sf_dir, "orders"), {"cheap": F.col("o_totalprice") < 300000, "settled": F.col("o_orderstatus").isin("O", "F")})
    return rows.select("o_orderkey", "cheap", "settled", "passes")


@query()
def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as units, two neighbouring ones a chunk, ranked by length, within a budget of 1500 characters."""
    c = table(spark, sf_dir, "conversations")
    units = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.length("text").alias("cost"))
    chunk = F.concat_ws("#", F.col("doc_id").cast("string"), F.floor(F.col("ordinal") / 2).cast("string"))
    chunk_units = units.select(chunk.alias("chunk_id"), "unit_id")
    size = units.groupBy(chunk.alias("chunk_id"), (F.col("doc_id") % 10).alias("query_id")).agg(F.sum("cost").alias("n"))
    from tamarisk.operators.lexical import top_k

    ranked = top_k(size, 6, item="chunk_id", score="n").select("query_id", "chunk_id", "rank")
    return experiments.assembled_context(ranked, chunk_units, units, 1500).withColumn("chunks", F.array_join("chunks", ","))
