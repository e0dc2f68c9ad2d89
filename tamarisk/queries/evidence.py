"""Queries of evidence, selections, rankings' checks and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import discovery
from tamarisk.queries.judgement import _pick, _sql_list
from tamarisk.queries.retrieval import _BM25, _TOP, bm25_ranking
from tamarisk.queries.tables import corpus, table
from tamarisk.registry import query


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), t AS (SELECT doc_id, trim(l) AS l FROM s)
SELECT doc_id, count(*) AS n, CAST(sum(length(l)) AS BIGINT) AS chars FROM t WHERE length(l) >= 24 AND len(regexp_extract_all(l, '\p{L}')) >= 8 GROUP BY 1""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents whose sentence ends were made commas."""
    d = corpus(spark, sf_dir).select("doc_id", F.translate("text", ".!?؟؛:[", ",,,,,,,").alias("text"))
    return discovery.segments(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("segment")).alias("chars"))


@query(r"""WITH l AS (SELECT conv_id || '/' || turn AS unit_id, role, 0 AS start, length(text) AS "end", text AS segment FROM conversations WHERE length(text) >= 24),
c AS (SELECT unit_id, 'the' AS category, 100 * len(regexp_extract_all(segment, 'the')) + least(length(segment), 900) + least(length(segment) // 8, 80) AS score FROM l WHERE contains(segment, 'the') AND contains(segment, 'on')
UNION ALL SELECT unit_id, 'que', 100 * len(regexp_extract_all(segment, 'que')) + least(length(segment), 900) + least(length(segment) // 8, 80) FROM l WHERE contains(segment, 'que') AND role = 'user') SELECT unit_id, category, CAST(score AS BIGINT) AS score, 1::BIGINT AS place FROM c""")
def evidence_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("length(text) >= 24")
    unit = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = c.select(unit.alias("unit_id"), F.col("role").alias("unit_type"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("segment"))
    found = discovery.opportunities(rows, {"the": {"cue": "the", "also": "on"}, "que": {"cue": "que", "types": "user"}})
    return found.select("unit_id", "category", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n, l_returnflag AS k FROM lineitem), f AS (SELECT d, min({'n': n, 'k': k}) AS f FROM u GROUP BY 1),
s AS (SELECT u.d, f, min({'n': n, 'k': k}) AS s FROM u JOIN f ON f.d = u.d WHERE k != f.k AND {'n': n, 'k': k} > f GROUP BY 1, 2) SELECT d AS l_orderkey, f.n AS first_n, f.k AS first_k, s.n AS second_n, s.k AS second_k FROM s""")
def paired_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first item and its next one of another flag."""
    rows = discovery.paired_evidence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber"])
    return rows.select("l_orderkey", *[F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in ("first", "second") for c, n in (("l_linenumber", "n"), ("l_returnflag", "k"))])


@query(r"""WITH w AS MATERIALIZED (SELECT conv_id AS d, turn AS p, role, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4)) AS w FROM conversations),
a AS (SELECT d, p, w FROM w WHERE role = 'user' AND len(w) >= 2), b AS (SELECT d, p, w FROM w WHERE role = 'assistant'), c AS (SELECT d, p, w FROM w),
t AS (SELECT a.d, min({'a': a.p, 'b': b.p, 'c': c.p}) AS t FROM a JOIN b ON b.d = a.d AND list_has_any(a.w, b.w) JOIN c ON c.d = a.d AND list_has_any(a.w, c.w) AND list_has_any(b.w, c.w) GROUP BY 1) SELECT d AS conv_id, t.a AS a, t.b AS b, t.c AS c FROM t""")
def linked_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that share long words: a user's, an assistant's and any."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), "role", "text")
    return discovery.linked_triples(c.where("role = 'user'"), c.where("role = 'assistant'"), c, "conv_id", (1000, 1000, 1000))


@query("""WITH u AS (SELECT doc_id AS unit_id, source AS document_id, text, CASE WHEN doc_id % 10 = 0 THEN ['low_signal'] ELSE ['money_percentage', 'temporal'] END AS strata FROM (SELECT doc_id, source || (doc_id % 20) AS source, sha256(text) || doc_id % 10 AS text FROM documents)),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY text ORDER BY unit_id) = 1), r AS (SELECT *, sha256('7:' || unit_id) AS rank FROM f),
l AS (SELECT * FROM r WHERE strata[1] = 'low_signal' ORDER BY rank LIMIT 1), p AS (SELECT *, 1 AS lead FROM r WHERE document_id NOT IN (SELECT document_id FROM l) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY rank) = 1),
h AS (SELECT * FROM (SELECT *, 0 AS lead FROM l UNION ALL SELECT * FROM p) ORDER BY lead, rank LIMIT 8), q AS (SELECT * FROM r WHERE document_id NOT IN (SELECT document_id FROM h)), m AS (SELECT * FROM q WHERE strata[1] = 'low_signal' ORDER BY rank LIMIT 1),
d AS (SELECT * FROM (SELECT *, 0 AS lead FROM m UNION ALL SELECT *, 1 FROM q WHERE unit_id NOT IN (SELECT unit_id FROM m)) ORDER BY lead, rank LIMIT 16)
SELECT unit_id, document_id, 'holdout' AS split, array_to_string(strata, ',') AS strata FROM h UNION ALL SELECT unit_id, document_id, 'dev', array_to_string(strata, ',') FROM d""")
def annotation_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight units of the holdout and sixteen of dev: a sampling operator."""
    k = F.col("doc_id")
    text = F.concat(F.sha2("text", 256), (k % 10).cast("string"))
    signal = F.when(k % 10 == 0, F.translate(text, "0123456789", "abcdefghij")).otherwise(F.concat(text, F.lit("% 1")))
    units = corpus(spark, sf_dir).select(k.alias("unit_id"), F.concat("source", (k % 20).cast("string")).alias("document_id"), signal.alias("text"))
    return discovery.annotation_selection(units, "7", 8, 16).withColumn("strata", F.array_join("strata", ","))


@query("WITH e AS (SELECT p_partkey % 50 AS q, p_partkey AS u, p_size AS s, p_size + 9 AS e, p_partkey % 3 AS g FROM part), c AS (SELECT l_orderkey AS k, l_partkey AS u, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 5 AS e FROM lineitem) SELECT q AS query_id, k AS chunk_id, max(g) AS grade FROM e JOIN c ON c.u = e.u AND e.s < c.e AND c.s < e.e GROUP BY 1, 2 HAVING max(g) > 0")
def span_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("p_partkey"), F.col("l_quantity").cast("long")
    evidence = table(spark, sf_dir, "part").select((k % 50).alias("query_id"), k.alias("unit_id"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 9).cast("long").alias("end"), (k % 3).alias("grade"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("unit_id"), q.alias("start"), (q + 5).alias("end"))
    return discovery.span_qrels(evidence, chunks)


@query("SELECT event_id, props ->> '$.k' AS k, CAST(NULL AS VARCHAR) AS title FROM events")
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *discovery.metadata_fields(F.col("props"), ["k", "title"]))


_ERRORS = ("TimeoutError", "HTTPError", "URLError", "ConnectionResetError", "JSONDecodeError", "KeyError")


@query(f"WITH e AS (SELECT event_id, {_sql_list(_ERRORS)}[event_id % 6 + 1] AS e, event_id % 2 = 0 AS r FROM events) SELECT event_id, CASE e WHEN 'TimeoutError' THEN CASE WHEN r THEN 'read_timeout' ELSE 'overall_timeout' END WHEN 'HTTPError' THEN 'http_error' WHEN 'URLError' THEN 'connection_error' WHEN 'ConnectionResetError' THEN 'connection_error' WHEN 'JSONDecodeError' THEN 'malformed_response' ELSE 'other' END AS phase FROM e")
def failure_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k, discovery.failure_phase(_pick(_ERRORS, k), k % 2 == 0).alias("phase"))


@query("SELECT event_type, count(value) AS count, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.95), 8) AS p95, max(value) AS max FROM events GROUP BY 1")
def timeout_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"WITH {_BM25}, r AS (SELECT query_id, doc_id, {_TOP} AS rank FROM bm25 QUALIFY rank <= 8), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1) SELECT query_id, doc_id, rank FROM r WHERE query_id IN (SELECT query_id FROM n WHERE n = 8) AND query_id % 5 > 0")
def served_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 > 0, "completed").otherwise("failed").alias("status"))
    return discovery.served_rankings(bm25_ranking(spark, sf_dir, 10).select("query_id", "doc_id", "rank"), status)[0]


@query("""WITH s AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS i, l_linenumber AS n, l_linenumber * 1.5 + l_orderkey % 7 AS v FROM lineitem), b AS (SELECT i, v FROM s WHERE n = 1)
SELECT 'bm25' AS system, 'd' || n AS dialect, count(*) AS n, round(avg(b.v), 8) AS base, round(avg(s.v), 8) AS variant, round(avg(s.v - b.v), 8) AS delta FROM s JOIN b USING (i) WHERE n > 1 GROUP BY s.n""")
def variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("l_linenumber"), F.col("l_orderkey")
    s = table(spark, sf_dir, "lineitem").select(i, n).distinct()
    return discovery.variant_matrix(s.select(F.lit("bm25").alias("system"), i.alias("intent"), F.when(n > 1, F.concat(F.lit("d"), n.cast("string"))).alias("dialect"), (n * 1.5 + i % 7).alias("value")))


@query("""WITH r AS (SELECT o_orderkey % 5 AS g, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 4 END AS f, o_orderkey % 3 > 0 AS c, o_orderkey % 2 AS d, o_orderkey % 7 AS m, o_orderkey % 6 AS a FROM orders),
k AS (SELECT unnest([{'kind': 'PIPELINE_FAILURE', 'n': count(*) FILTER (f IS NULL)}, {'kind': 'MISSED_EXTRACTION', 'n': CAST(sum(greatest(g - f, 0)) FILTER (f IS NOT NULL) AS BIGINT)}, {'kind': 'SPURIOUS_EXTRACTION', 'n': CAST(sum(greatest(f - g, 0)) FILTER (f IS NOT NULL) AS BIGINT)},
  {'kind': 'WRONG_CANDIDATE_CLASSIFICATION', 'n': count(*) FILTER (f IS NOT NULL AND NOT c)}, {'kind': 'DUPLICATE_EXTRACTION', 'n': CAST(sum(d) FILTER (f IS NOT NULL) AS BIGINT)}, {'kind': 'WRONG_MODALITY', 'n': CAST(sum(m) FILTER (f IS NOT NULL) AS BIGINT)}, {'kind': 'WRONG_ACTOR_ACTION_ASSOCIATION', 'n': CAST(sum(a) FILTER (f IS NOT NULL) AS BIGINT)}]) AS x FROM r) SELECT x.kind AS kind, x.n AS n FROM k""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return discovery.failure_taxonomy(table(spark, sf_dir, "orders").select(
        (k % 5).alias("gold_rules"), F.when(k % 9 > 0, k % 4).alias("found_rules"), (k % 3 > 0).alias("same_candidates"), (k % 2).alias("duplicates"), (k % 7).alias("wrong_modality"), (k % 6).alias("wrong_actor"),
    ))


@query("SELECT 'urgent' AS kind, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'none', NULL")
def sanity_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.first_of_each(table(spark, sf_dir, "orders"), "o_orderkey", {"urgent": F.col("o_orderpriority") == "1-URGENT", "none": F.col("o_orderkey") < 0})


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 < 2")
def eligible_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.lit("Saudi_Arabia").alias("jurisdiction"), F.lit("primary_corpus").alias("source_role"), F.lit("dataset").alias("source_type"), _pick(("approved", "conditional", "blocked"), k).alias("decision"), F.when(F.col("p_size") % 2 == 0, "article").otherwise("case_text").alias("unit_type"))
    return discovery.eligible(rows).select("p_partkey")
