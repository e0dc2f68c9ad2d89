"""Chunking, grounding, extraction and corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import chunking, corpus as units, extraction, grounding, lexical
from tamarisk.queries.retrieval import _BM25, _TOP, bm25_ranking
from tamarisk.queries.tables import benchmark, corpus, table
from tamarisk.registry import query

_COUNT = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query()
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_texts(corpus(spark, sf_dir))


@query()
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.split_texts(corpus(spark, sf_dir)).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    return chunking.chunk_summary(chunks, "doc_id", "n")


@query(f"""WITH t AS MATERIALIZED (SELECT doc_id, {_COUNT} AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 256) / 224)) AS BIGINT) + 1)) AS win FROM t WHERE n > 0)
SELECT doc_id, win AS window, win * 224 AS first, least(win * 224 + 256, n) AS last FROM w""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(corpus(spark, sf_dir)).withColumn("window", F.col("window").cast("long"))


@query("SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.neighbour_context(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "context")


_SPANS = "s AS (SELECT l_partkey AS key, CAST(l_quantity AS BIGINT) AS start, CAST(l_quantity AS BIGINT) + l_linenumber AS \"end\" FROM lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"))


@query(f"""WITH {_SPANS}, n AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT key, min(start) AS start, max("end") AS "end" FROM i GROUP BY key, island""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.merged_spans(_spans(spark, sf_dir), "key")


_GOLD = "g AS (SELECT p_partkey AS key, p_size AS gold_start, p_size + 7 AS gold_end FROM part)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("gold_start"), (F.col("p_size") + 7).cast("long").alias("gold_end"))


_OVERLAP = f"""WITH {_SPANS}, {_GOLD}, o AS (SELECT *, least("end", gold_end) - greatest(start, gold_start) AS shared FROM g JOIN s USING (key) WHERE least("end", gold_end) > greatest(start, gold_start))"""


@query(_OVERLAP + ' SELECT key, CAST(gold_start AS BIGINT) AS gold_start, CAST(gold_end AS BIGINT) AS gold_end, start, "end", shared FROM o')
def span_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.span_overlaps(_gold(spark, sf_dir), _spans(spark, sf_dir), "key")


@query(_OVERLAP + """ SELECT g.key, coalesce(round(max(shared / (o.gold_end - o.gold_start)), 8), 0) AS recall, coalesce(round(max(shared / ("end" - start)), 8), 0) AS precision FROM g LEFT JOIN o ON o.key = g.key GROUP BY 1""")
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    return chunking.span_metrics(chunking.span_overlaps(gold, _spans(spark, sf_dir), "key"), gold, ["key"])


_TURNS = "turns AS (SELECT conv_id AS doc_id, conv_id * 1000 + turn AS unit_id, turn AS ordinal, role, text FROM conversations)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), F.col("turn").alias("ordinal"), "role", "text")


def _chunk_ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks are pairs of following turns; every benchmark passage ranks them by shared tokens."""
    u = _units(spark, sf_dir)
    chunk_units = u.select(F.expr("doc_id * 1000 + ordinal div 2").alias("chunk_id"), "unit_id")
    scored = lexical.jaccard(u.select(F.col("unit_id").alias("doc_id"), "text"), benchmark(spark, sf_dir))
    scored = scored.withColumn("chunk_id", F.expr("(doc_id div 1000) * 1000 + (doc_id % 1000) div 2")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return lexical.top_k(scored, 8, item="chunk_id").select("query_id", "chunk_id", "rank"), chunk_units


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
_PROVENANCE = rf"""WITH {_TURNS}, ql AS MATERIALIZED (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS l FROM benchmark), dl AS MATERIALIZED (SELECT unit_id, list_distinct({_TOKENS}) AS l FROM turns),
q AS (SELECT query_id, unnest(l) AS token, len(l) AS nq FROM ql), d AS (SELECT unit_id, unnest(l) AS token, len(l) AS nd FROM dl),
sc AS (SELECT query_id, unit_id, round(count(*) / (any_value(nq) + any_value(nd) - count(*)), 8) AS score FROM q JOIN d USING (token) GROUP BY 1, 2),
ch AS (SELECT query_id, (unit_id // 1000) * 1000 + (unit_id % 1000) // 2 AS chunk_id, max(score) AS score FROM sc GROUP BY 1, 2),
ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ch QUALIFY rank <= 8),
prov AS (SELECT query_id, doc_id, unit_id, any_value(ordinal) AS ordinal, min(rank) AS rank, any_value(text) AS text
  FROM ranked JOIN turns t ON t.doc_id * 1000 + t.ordinal // 2 = ranked.chunk_id GROUP BY 1, 2, 3)"""


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, chunk_units = _chunk_ranking(spark, sf_dir)
    return grounding.provenance(ranked, chunk_units, _units(spark, sf_dir).drop("role", "text"))


@query(_PROVENANCE + " SELECT query_id, doc_id, unit_id, ordinal, rank FROM prov")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _provenance(spark, sf_dir).drop("chunks")


@query(_PROVENANCE + """, n AS (SELECT *, CASE WHEN ordinal = lag(ordinal) OVER (PARTITION BY query_id, doc_id ORDER BY ordinal) + 1 THEN 0 ELSE 1 END AS new FROM prov)
SELECT query_id, doc_id, unit_id, CAST(sum(new) OVER (PARTITION BY query_id, doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM n""")
def islands_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.blocks(_provenance(spark, sf_dir), ["query_id", "doc_id"]).select("query_id", "doc_id", "unit_id", "block")


@query()
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = _units(spark, sf_dir).select("unit_id", F.length("text").cast("long").alias("cost"))
    rows = _provenance(spark, sf_dir).drop("chunks").join(cost, "unit_id")
    return grounding.within_budget(rows, "query_id", ["rank", "doc_id", "ordinal", "unit_id"], "cost", 1500).select("query_id", "unit_id", "rank", "cost", "admitted")


_CITES = f"WITH {_BM25}, ev AS (SELECT query_id AS evidence_id, doc_id AS chunk_id, {_TOP} AS rank FROM bm25 QUALIFY rank <= 5), c AS (SELECT item_id AS claim_id, CASE WHEN item_id % 7 = 0 THEN -1 ELSE item_id END AS evidence_id, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE text END AS quote FROM benchmark)"
_CITED = """, j AS (SELECT c.*, e.chunk_id, e.rank, d.text FROM c LEFT JOIN ev e ON e.evidence_id = c.evidence_id LEFT JOIN documents d ON d.doc_id = e.chunk_id),
cited AS (SELECT claim_id, evidence_id, quote, CASE WHEN max(CASE WHEN text IS NULL THEN 0 ELSE 1 END) = 0 THEN 'unknown_evidence' WHEN trim(quote) = '' THEN 'blank_quote' WHEN count(*) FILTER (contains(text, quote)) = 0 THEN 'not_in_evidence' ELSE 'valid' END AS status,
  CASE WHEN trim(quote) != '' THEN arg_min(chunk_id, rank * 1000000000 + chunk_id) FILTER (contains(text, quote)) END AS chunk_id FROM j GROUP BY 1, 2, 3)"""


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bm25_ranking(spark, sf_dir, 5).select(F.col("query_id").alias("evidence_id"), F.col("doc_id").alias("chunk_id"), "rank")
    ev = ev.join(corpus(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    b = benchmark(spark, sf_dir)
    quote = F.when(F.col("query_id") % 5 == 0, " ").otherwise(F.col("text"))
    named = F.when(F.col("query_id") % 7 == 0, -1).otherwise(F.col("query_id"))
    return grounding.verified_citations(b.select(F.col("query_id").alias("claim_id"), named.alias("evidence_id"), quote.alias("quote")), ev)


@query(_CITES + _CITED + " SELECT * FROM cited")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir)


@query(_CITES + _CITED + """ SELECT item_id // 2 AS draft_id, bool_and(s.status = 'valid') AS accepted FROM benchmark b JOIN cited s ON s.claim_id = b.item_id GROUP BY 1""")
def draft_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = benchmark(spark, sf_dir)
    claims = b.select(F.expr("query_id div 2").alias("draft_id"), F.col("query_id").alias("claim_id"), F.col("text").alias("claim"))
    drafts = claims.groupBy("draft_id").agg(F.array_join(F.array_sort(F.collect_list("claim")), "\n").alias("answer"))
    return grounding.verified_drafts(drafts, claims, _citations(spark, sf_dir).select("claim_id", "status"))


@query(r"""SELECT item_id, CASE WHEN trim(q) = '' THEN 'requested_info_not_found' WHEN regexp_matches(q, '(?i)\b(?:should\s+(?:i|we)|do\s+i\s+need\s+to|can\s+i\s+sue|may\s+i\s+(?:sign|pay))\b') THEN 'personalized_legal_advice'
  WHEN contains(lower(q), 'egypt') THEN 'jurisdiction_mismatch' WHEN regexp_matches(q, '(?i)\b(?:current|currently|latest|in\s+force|valid\s+today|up[- ]to[- ]date)\b') THEN 'currentness_unverified'
  WHEN length(text) % 3 = 0 THEN 'no_context' WHEN length(text) / 1000 < 0.1 THEN 'low_retrieval_confidence' END AS reason
FROM (SELECT item_id, text, ['', 'should I ', 'law of Egypt ', 'is it in force ', 'which '][item_id % 5 + 1] || CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS q FROM benchmark)""")
def answerability_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(*map(F.lit, ("", "should I ", "law of Egypt ", "is it in force ", "which "))), (F.col("query_id") % 5 + 1).cast("int"))
    b = benchmark(spark, sf_dir).withColumn("q", F.concat(start, F.when(F.col("query_id") % 5 == 0, "").otherwise(F.col("text"))))
    reason = grounding.answerability(F.col("q"), ["SA"], F.length("text") % 3, F.length("text") / 1000, 0.1)
    return b.select(F.col("query_id").alias("item_id"), reason.alias("reason"))


@query("WITH f AS (SELECT conv_id, role, text, min(turn) AS turn FROM conversations GROUP BY 1, 2, 3) SELECT conv_id, turn, 'Q' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS quote_ref FROM (SELECT conv_id, text, min(turn) AS turn FROM f GROUP BY 1, 2)")
def quote_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.quote_registry(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "quote_ref")


@query()
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.candidates(corpus(spark, sf_dir))


@query("""SELECT p_partkey AS doc_id, ordinal, unit_type, text FROM (SELECT p_partkey, 1 AS ordinal, 'p_name' AS unit_type, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 3, 'p_type', p_type FROM part) WHERE trim(text) != ''""")
def unpivot_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unpivoted_units(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], ["p_size"]).drop("metadata")


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS lowest, max(l_linenumber) AS highest, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def group_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.group_contiguity(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_returnflag, count(*) AS n, CASE WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT l_linenumber) = count(*) THEN 'series' ELSE 'conflicting' END AS status FROM lineitem GROUP BY 1, 2""")
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.group_status(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber", "l_linestatus", "l_linestatus")


@query("""WITH w AS (SELECT o_orderkey AS k, o_orderkey % 9 AS wanted FROM orders)
SELECT k AS l_orderkey, wanted, arg_min(l_linenumber, abs(l_linenumber - wanted) * 1000 + l_linenumber) AS nearest FROM w LEFT JOIN lineitem ON l_orderkey = k GROUP BY 1, 2""")
def nearest_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 9).alias("wanted"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"))
    return units.nearest_ordinals(wanted, li, "l_orderkey", "l_linenumber")


@query("WITH f AS (SELECT conv_id, max(CASE WHEN role != 'system' AND trim(text) != '' THEN 1 ELSE 0 END) AS s FROM conversations GROUP BY 1) SELECT conv_id, turn, role FROM conversations JOIN f USING (conv_id) WHERE role != 'system' OR s = 0")
def suppressed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.suppressed(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", "system").select("conv_id", "turn", "role")


_BOXES = """b AS (SELECT l_orderkey AS page, l_linenumber AS block_id, l_quantity AS x0, l_quantity * 1.5 AS y0, l_quantity + 10 AS x1, l_quantity * 1.5 + 8 AS y1 FROM lineitem),
g AS (SELECT o_orderkey AS page, o_orderkey % 40 AS g_x0, o_orderkey % 60 AS g_y0, o_orderkey % 40 + 20 AS g_x1, o_orderkey % 60 + 30 AS g_y1 FROM orders)"""


@query(f"""WITH {_BOXES}, o AS (SELECT page, block_id, greatest(0, least(x1, g_x1) - greatest(x0, g_x0)) * greatest(0, least(y1, g_y1) - greatest(y0, g_y0)) / ((x1 - x0) * (y1 - y0)) AS covered,
  (x0 + x1) / 2 BETWEEN g_x0 AND g_x1 AND (y0 + y1) / 2 BETWEEN g_y0 AND g_y1 AS centre FROM g JOIN b USING (page)) SELECT page, block_id, round(covered, 8) AS covered FROM o WHERE covered >= 0.2 OR centre""")
def spatial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_id"), q.alias("x0"), (q * 1.5).alias("y0"), (q + 10).alias("x1"), (q * 1.5 + 8).alias("y1"))
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select(k.alias("page"), (k % 40).alias("g_x0"), (k % 60).alias("g_y0"), (k % 40 + 20).alias("g_x1"), (k % 60 + 30).alias("g_y1"))
    return units.box_matches(g, b, "page").select("page", "block_id", "covered")


@query("""SELECT a.item_id AS query_id, d.doc_id FROM benchmark a JOIN documents d ON length(trim(regexp_replace(lower(a.text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) >= 12
AND contains(trim(regexp_replace(lower(d.text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), trim(regexp_replace(lower(a.text), '[^\\p{L}\\p{N}_]+', ' ', 'g')))""")
def direct_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage word by word, found through the passage's longest inner word."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_]+", " "))
    q = benchmark(spark, sf_dir).select("query_id", plain(F.col("text")).alias("p")).where(F.length("p") >= 12)
    inner = F.transform(F.slice(F.split("p", " "), F.lit(2), F.greatest(F.size(F.split("p", " ")) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    q = q.withColumn("w", F.array_max(inner)["w"])
    d = corpus(spark, sf_dir).select("doc_id", plain(F.col("text")).alias("t"))
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    found = words.join(q.where("w is not null"), "w").select("query_id", "doc_id", "p").join(d, "doc_id").where(F.contains("t", "p"))
    few = d.join(q.where("w is null").select("query_id", "p"), F.contains("t", "p"))
    return found.select("query_id", "doc_id").unionByName(few.select("query_id", "doc_id"))


@query()
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question, answered from the documents."""
    from tamarisk.plans.answering import answers as run

    return run(corpus(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir), sparse=bm25_ranking(spark, sf_dir, 50))


@query()
def diverse_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's customers five that differ in segment and balance: a sampling operator."""
    from tamarisk.operators.picking import diverse

    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 2000).cast("int").alias("band"))
    return diverse(c, "c_nationkey", ["c_mktsegment", "band"], "c_custkey", 5, 3)


@query()
def block_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items as gold boxes against the same boxes moved, every third one named."""
    from tamarisk.operators.picking import matched_blocks

    q, n = F.col("l_quantity"), F.col("l_linenumber")
    name = F.when(n % 3 == 0, F.concat(F.lit("b"), n.cast("string")))
    box = lambda d: [q.alias("x0"), (q + d).alias("y0"), (q + 10).alias("x1"), (q + 8 + d).alias("y1")]
    li = table(spark, sf_dir, "lineitem")
    gold, found = (li.select(F.col("l_orderkey").alias("page"), n.cast("long").alias("place"), name.alias("name"), *box(d)) for d in (0, 1))
    return matched_blocks(gold, found, "page")
