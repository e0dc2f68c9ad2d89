"""Queries of comparisons, structure and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import analysis, fusion, lexical, metrics
from tamarisk.queries.evaluation import gold_qrels
from tamarisk.queries.retrieval import _BM25, _DENSE, _TOKENS, _TOP, bm25_ranking, dense_ranking, jaccard_ranking
from tamarisk.queries.tables import benchmark, corpus, table
from tamarisk.registry import query


@query(rf"WITH l AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS l FROM documents) SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS token FROM l) GROUP BY 1, 2")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(corpus(spark, sf_dir)).drop("length")


@query(rf"WITH l AS MATERIALIZED (SELECT doc_id, list_distinct({_TOKENS}) AS l FROM documents) SELECT token, count(*) AS df FROM (SELECT unnest(l) AS token FROM l) GROUP BY 1")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(corpus(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"))


@query("""SELECT l_returnflag, count(*) AS pairs, round(avg(b.l_quantity), 8) AS base, round(avg(v.l_quantity), 8) AS variant, round(avg(b.l_quantity - v.l_quantity), 8) AS delta, count(*) < 10 AS small_sample
FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1) b JOIN (SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_linenumber != 1) v USING (l_orderkey) GROUP BY 1""")
def robustness_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("variant_id", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")))
    return analysis.robustness(li.select("l_orderkey", "variant_id", "l_returnflag", "l_quantity"), "l_orderkey", "variant_id", "l_returnflag", "l_quantity")


@query(f"""WITH {_DENSE}, a AS (SELECT query_id, doc_id, score, {_TOP} AS rank FROM dense QUALIFY rank <= 10),
slow AS (SELECT x.vec_id AS query_id, y.vec_id AS doc_id, round(list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])), 10) AS score FROM vecs x, vecs y WHERE x.vec_id % 50 = 0), b AS (SELECT query_id, doc_id, score, {_TOP} AS rank FROM slow QUALIFY rank <= 10)
SELECT count(*) AS places, count(*) FILTER (a.doc_id != b.doc_id) AS mismatches, round(max(abs(a.score - b.score)), 8) AS largest_gap, bool_and(abs(a.score - b.score) <= 1e-6) AS within FROM a JOIN b USING (query_id, rank)""")
def index_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's block products against every pair's products summed one dimension after the other."""
    from tamarisk.operators.dense import plain_top_k
    from tamarisk.queries.tables import QUERY_ROWS, vectors

    v = vectors(spark, sf_dir)
    slow = plain_top_k(v, v.where(F.col("id") % QUERY_ROWS == 0), 10)
    return analysis.ranking_parity(dense_ranking(spark, sf_dir, 10), slow).withColumn("largest_gap", F.round("largest_gap", 8))


@query()
def fusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense weight of the best mean nDCG among those that don't lose recall."""
    sparse, dense, gold = bm25_ranking(spark, sf_dir, 50), jaccard_ranking(spark, sf_dir, 50), gold_qrels(spark, sf_dir)
    rows = None
    for weight in (0.0, 0.25, 0.5, 1.0):
        m = metrics.query_metrics(fusion.reciprocal_rank_fusion(sparse, dense, 1.0, weight).select("query_id", "doc_id", "rank"), gold, 10)
        one = m.agg(F.lit(weight).alias("weight"), F.round(F.avg("ndcg"), 8).alias("ndcg"), F.round(F.avg("recall"), 8).alias("recall"))
        rows = one if rows is None else rows.unionByName(one)
    return analysis.grid_search(rows, "ndcg", "recall", 0.5)


@query(f"WITH {_BM25}, top AS (SELECT query_id, doc_id, score, {_TOP} AS rank FROM bm25 QUALIFY rank <= 10) SELECT query_id, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 8) AS mean, quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95 FROM top GROUP BY 1")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.score_distribution(bm25_ranking(spark, sf_dir, 10), "query_id", "score")


@query("""WITH s AS (SELECT doc_id % 3 AS split, text, source FROM documents), v AS (SELECT split, 'text' AS key, text AS v FROM s UNION ALL SELECT split, 'source', source FROM s),
c AS (SELECT key, v, count(DISTINCT split) AS s FROM v GROUP BY 1, 2) SELECT key, count(*) AS total, count(*) FILTER (s > 1) AS crossing FROM c GROUP BY 1""")
def split_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.split_diagnostics(corpus(spark, sf_dir).withColumn("split", F.col("doc_id") % 3), "split", ["text", "source"])


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS rate FROM documents GROUP BY 1, 2")
def source_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.balance(corpus(spark, sf_dir), "lang", "source")


@query("""WITH k AS (SELECT DISTINCT source, CAST(doc_id AS VARCHAR) AS k FROM documents), p AS (SELECT source, substr(sha256(k), 1, 2) AS p, count(*) AS n, sha256(string_agg(k, ',' ORDER BY k)) AS d FROM k GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, ',' ORDER BY p)) AS digest FROM p GROUP BY 1""")
def freeze_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.set_digest(corpus(spark, sf_dir), "source", "doc_id")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_a, count(*) FILTER (d.doc_id IS NULL) AS only_b FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def qrel_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.same_sets(corpus(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH p AS (SELECT x.l_orderkey, count(*) AS comparable, count(*) FILTER (x.l_partkey < y.l_partkey) AS concordant FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.l_partkey != y.l_partkey GROUP BY 1)
SELECT l_orderkey, coalesce(comparable, 0) AS comparable, coalesce(concordant, 0) AS concordant, CASE WHEN comparable IS NULL THEN 1.0 ELSE round(concordant / comparable, 8) END AS accuracy FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN p USING (l_orderkey)""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.pairwise_order(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH w AS (SELECT conv_id, role, unnest(string_split(lower(text), ' ')) AS w FROM conversations), a AS (SELECT conv_id, w, count(*) AS n FROM w WHERE role = 'user' GROUP BY 1, 2), b AS (SELECT conv_id, w, count(*) AS m FROM w WHERE role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, CAST(sum(least(n, m)) AS BIGINT) AS shared FROM a JOIN b USING (conv_id, w) GROUP BY 1""")
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return analysis.multiset_overlap(w.where("role = 'user'"), w.where("role = 'assistant'"), "conv_id", "w")


@query("WITH p AS (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem) SELECT l_orderkey, coalesce(bool_or(l_partkey < p), false) AS violated FROM p GROUP BY 1")
def ordering_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.ordering_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


@query("""SELECT DISTINCT CAST(conv_id AS VARCHAR) AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'document' AS kind FROM conversations UNION ALL
SELECT DISTINCT conv_id || '/' || role, CAST(conv_id AS VARCHAR), 'section' FROM conversations UNION ALL SELECT DISTINCT conv_id || '/' || role || '/' || turn, conv_id || '/' || role, 'unit' FROM conversations""")
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.tree(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


@query("SELECT conv_id || '/' || role || '/' || turn AS node_id, 'orphan' AS fault FROM conversations WHERE role = 'system'")
def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of the tree of conversations whose system sections are missing."""
    nodes = analysis.tree(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn")
    return analysis.tree_faults(nodes.where("not (kind = 'section' and node_id like '%/system')"))


@query("SELECT doc_id, CASE WHEN n_chars < 5 AND doc_id % 3 > 0 THEN 'ocr' WHEN contains(text, '@') OR n_chars < 80 OR doc_id % 3 > 0 THEN 'mixed' ELSE 'embedded' END AS route FROM documents")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = analysis.page_route(F.col("n_chars"), F.col("doc_id") % 3, F.contains("text", F.lit("@")))
    return table(spark, sf_dir, "documents").select("doc_id", route.alias("route"))


@query(r"SELECT p_partkey, list_has_any(regexp_extract_all(lower(p_name), '[a-z0-9]+'), regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS matches FROM part")
def scope_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", analysis.scope_matches(F.col("p_name"), F.col("p_type")).alias("matches"))


@query(r"""WITH t AS (SELECT doc_id, text || ' no. ' || doc_id || '-' || n_chars || CASE WHEN doc_id % 3 = 0 THEN ' -' || doc_id ELSE '' END AS x FROM documents), y AS (SELECT doc_id, x, trim(regexp_replace(x, '\s+', ' ', 'g')) AS y FROM t)
SELECT doc_id, regexp_extract_all(x, '[0-9][-/.:]') = regexp_extract_all(y, '[0-9][-/.:]') AND regexp_extract_all(x, '[-/.:][0-9]') = regexp_extract_all(y, '[-/.:][0-9]') AS kept, len(regexp_extract_all(y, '[0-9][-/.:]')) + len(regexp_extract_all(y, '[^0-9][-/.:][0-9]')) AS marks FROM y""")
def identifier_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the light normal form leaves the separators of identifiers alone."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    x = F.concat("text", F.lit(" no. "), k, F.lit("-"), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" -"), k)).otherwise(""))
    d = d.select("doc_id", x.alias("x")).withColumn("y", T.normalised(F.col("x"), "light"))
    marks = F.size(F.regexp_extract_all("y", F.lit("[0-9][-/.:]"), F.lit(0))) + F.size(F.regexp_extract_all("y", F.lit("[^0-9][-/.:][0-9]"), F.lit(0)))
    return d.select("doc_id", analysis.separators_kept(F.col("x"), F.col("y")).alias("kept"), marks.cast("long").alias("marks"))


@query(r"""WITH w AS MATERIALIZED (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations),
g AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) ELSE [] END AS g FROM w)
SELECT a.conv_id, a.turn, CASE WHEN len(a.g) > 0 THEN round(len(list_intersect(a.g, b.g)) / len(a.g), 8) ELSE 0 END AS overlap FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def gram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(analysis.gram_overlap(F.col("text"), F.col("other")), 8).alias("overlap"))


@query("SELECT doc_id, CASE WHEN contains(text, ' ') THEN sha256(substr(text, 1, strpos(text, ' ') - 1) || '  ' || substr(text, strpos(text, ' ') + 1)) END AS double_space, CASE WHEN length(text) > 0 THEN sha256(chr(65279) || text) END AS bom FROM documents")
def perturbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = analysis.perturbations(F.col("text"))
    return corpus(spark, sf_dir).select("doc_id", *[F.sha2(p[k], 256).alias(k) for k in ("double_space", "bom")])


@query("""WITH j AS (SELECT d.doc_id, d.text, 'the' AS piece FROM documents d), c AS (SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n, strpos(text, 'the') - 1 AS place FROM j)
SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN place ELSE -1 END AS start FROM c""")
def span_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis.resolved_spans(corpus(spark, sf_dir).withColumn("piece", F.lit("the")), "text", "piece")
    return rows.select("doc_id", "span.status", F.col("span.start").cast("long").alias("start"))


@query("SELECT doc_id, CASE WHEN quality = 1 - toxic THEN CASE WHEN quality = 1 THEN 'KEEP' ELSE 'DROP' END ELSE 'UNCERTAIN' END AS verdict, least(0.9::DOUBLE, 0.6 + doc_id % 5 / 10) AS confidence FROM labels")
def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = lambda c: F.when(c == 1, "KEEP").otherwise("DROP")
    v, c = analysis.agreed(verdict(F.col("quality")), verdict(1 - F.col("toxic")), F.lit(0.9), F.lit(0.6) + F.col("doc_id") % 5 / 10)
    return table(spark, sf_dir, "labels").select("doc_id", v.alias("verdict"), c.alias("confidence"))


@query("SELECT query_id, doc_id, score, rank FROM (WITH " + _BM25 + f" SELECT query_id, doc_id, score, {_TOP} AS rank FROM bm25 QUALIFY rank <= 10) WHERE query_id IN (SELECT item_id FROM benchmark ORDER BY sha256(CAST(item_id AS VARCHAR)), item_id LIMIT 20)")
def dev_query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings of the twenty queries that a hash picks: a sampling operator."""
    picked = benchmark(spark, sf_dir).select("query_id").orderBy(F.sha2(F.col("query_id").cast("string"), 256), "query_id").limit(20)
    return bm25_ranking(spark, sf_dir, 10).join(picked, "query_id", "left_semi")
