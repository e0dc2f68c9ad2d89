"""Queries of policies, outcomes, reviews and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import policy, review
from tamarisk.queries.tables import benchmark, table
from tamarisk.registry import query


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ASKED = ("which future law ", "the official text of ", "was it amended by ", "did he have paid for ", "the operative part of ", "the operative part is missing of ", "before the commercial court ", "was it paid in case 7 of ", "what about ")


@query(f"""WITH q AS (SELECT item_id, {_sql_list(_ASKED)}[item_id % {len(_ASKED)} + 1] || substr(text, 1, 20) AS q, item_id % 2 = 0 AS known, item_id % 4 = 0 AS prim, ['ruling', 'facts'][item_id % 2 + 1] AS role FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(q, 'future law') THEN 'future_law_unknowable' WHEN regexp_matches(q, 'official') AND NOT prim THEN 'authoritative_source_unavailable'
  WHEN regexp_matches(q, 'amended') AND NOT known THEN 'currentness_unverified' WHEN regexp_matches(q, 'paid') AND NOT regexp_matches(q, 'case 7') THEN 'case_facts_not_established'
  WHEN regexp_matches(q, 'operative') AND (regexp_matches(q, 'missing') OR role != 'ruling') THEN 'required_case_section_missing' WHEN regexp_matches(q, 'commercial court') AND item_id % 5 > 0 THEN 'forum_or_source_scope_mismatch'
  WHEN item_id % 3 = 0 THEN 'no_context' END AS reason FROM q""")
def second_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages behind phrases that the gate knows."""
    k = F.col("query_id")
    b = benchmark(spark, sf_dir).withColumn("q", F.concat(_pick(_ASKED, k), F.substring("text", 1, 20)))
    scope = F.when(k % 5 == 0, F.array(F.lit("court"))).otherwise(F.array(F.lit("0")))
    base = F.when(k % 3 == 0, "no_context")
    reason = policy.second_gate(F.col("q"), base, k % 4 == 0, F.array(_pick(("ruling", "facts"), k)), scope, k % 2 == 0, F.lit(False))
    return b.select(k.alias("item_id"), reason.alias("reason"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AND s_nationkey % 2 = 0 AND s_suppkey % 5 > 0 AS is_primary FROM supplier")
def primary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    flag = policy.primary_source(_pick(("Primary law", "secondary", "unknown"), k), _pick(("Official", "private"), k), _pick(("approved", "open"), n), F.when(k % 5 == 0, "blog").otherwise("Statute text"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", flag.alias("is_primary"))


_REASONS = ("currentness_unverified", "jurisdiction_mismatch", "personalized_legal_advice", "conflicting_evidence", "no_context", "superseded_source", "invalid_generation", None, None)
_DETAILS = ("not valid JSON at 1", "no exact authoritative substring", "semantic support unknown", "citation unknown", "")


@query(f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 7 THEN {_sql_list(tuple(x for x in _REASONS if x))}[o_orderkey % 9 + 1] END AS reason, {_sql_list(_DETAILS)}[o_orderkey % 5 + 1] AS detail, CASE WHEN o_orderkey % 9 = 8 THEN 'answer' ELSE 'abstain' END AS decision, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'answer' END AS raw FROM orders)
SELECT o_orderkey, CASE reason WHEN 'currentness_unverified' THEN 'pre_generation_currentness_status_policy' WHEN 'jurisdiction_mismatch' THEN 'pre_generation_jurisdiction_policy' WHEN 'personalized_legal_advice' THEN 'pre_generation_personalized_advice_policy'
  WHEN 'conflicting_evidence' THEN 'pre_generation_conflict_policy' WHEN 'no_context' THEN 'pre_generation_no_or_insufficient_context' WHEN 'superseded_source' THEN 'other_pre_generation_policy'
  ELSE CASE WHEN raw = 'none' AND decision = 'abstain' THEN 'other_pre_generation_policy' WHEN decision = 'abstain' AND reason IS NULL THEN 'generator_explicitly_returned_abstain' WHEN detail LIKE '%valid JSON%' THEN 'invalid_or_malformed_generator_output'
  WHEN detail LIKE '%exact authoritative substring%' THEN 'non_exact_quote' WHEN detail LIKE '%semantic support%' THEN 'semantic_support_diagnostic' WHEN detail LIKE '%citation%' THEN 'invalid_citation_or_evidence_id' WHEN decision = 'answer' THEN 'successful_verified_answer' ELSE 'other' END END AS outcome FROM r""")
def first_decisive_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = policy.first_decisive(F.when(k % 9 == 8, "answer").otherwise("abstain"), _pick(_REASONS, k), F.when(k % 4 == 0, "none").otherwise("answer"), _pick(_DETAILS, k), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("outcome"))


_DRAFTS = """d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'abstain' ELSE 'answer' END AS decision FROM orders),
c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), m AS (SELECT *, n % 3 = 0 AS i, CASE WHEN n % 3 = 0 AND k % 11 > 0 THEN 'claim ' || n END AS text, k % 2 = 0 AS supported, CASE WHEN k % 5 = 0 AND n = 2 THEN 'not_in_evidence' ELSE 'valid' END AS status FROM c)"""


@query(f"""WITH {_DRAFTS}, s AS (SELECT *, status = 'valid' AND NOT (i AND text IS NULL) AS sound FROM m), t AS (SELECT *, sound AND (NOT i OR supported) AS stands FROM s),
g AS (SELECT k, bool_and(sound) AS sound, bool_or(stands) AS stood, string_agg(CASE WHEN i THEN text || chr(10) ELSE '' END || '[E' || n || '] quote ' || n || ' (part ' || k || ')', chr(10) ORDER BY n) FILTER (stands) AS body FROM t GROUP BY k),
r AS (SELECT d.k, decision, body, CASE WHEN decision != 'answer' THEN NULL WHEN NOT coalesce(sound, false) THEN 'invalid_generation' WHEN NOT stood THEN 'semantic_support_unavailable' END AS reason FROM d LEFT JOIN g USING (k))
SELECT k AS draft_id, CASE WHEN decision = 'answer' AND reason IS NULL THEN 'answer' ELSE 'abstain' END AS decision, reason, CASE WHEN decision = 'answer' AND reason IS NULL THEN 'Jurisdiction: SA' || chr(10) || body || chr(10) || 'No advice.' END AS answer FROM r""")
def finalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts and their items as claims, each with one citation."""
    k, n = F.col("draft_id"), F.col("claim_no")
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draft_id"), F.when(F.col("o_orderkey") % 7 == 0, "abstain").otherwise("answer").alias("decision"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("claim_no")).distinct()
    text = F.when((n % 3 == 0) & (k % 11 > 0), F.concat(F.lit("claim "), n.cast("string")))
    claims = c.select("draft_id", "claim_no", F.when(n % 3 == 0, "interpretation").otherwise("direct").alias("mode"), text.alias("text"), (k % 2 == 0).alias("supported"))
    name = n.cast("string")
    cites = c.select("draft_id", "claim_no", F.lit(0).alias("place"), F.concat(F.lit("E"), name).alias("evidence_id"), F.concat(F.lit("quote "), name).alias("quote"), F.concat(F.lit("part "), k.cast("string")).alias("source"), F.when((k % 5 == 0) & (n == 2), "not_in_evidence").otherwise("valid").alias("status"))
    return policy.finalised(drafts, claims, cites, "SA", "No advice.")


@query("""WITH r AS (SELECT conv_id AS draft_id, 1 AS claim_no, turn AS place, 'Q' || lpad(CAST(turn % 5 AS VARCHAR), 3, '0') AS quote_ref FROM conversations), g AS (SELECT conv_id AS draft_id, 'Q' || lpad(CAST(turn AS VARCHAR), 3, '0') AS quote_ref, 'E' || turn AS evidence_id, md5(text) AS quote FROM conversations)
SELECT r.draft_id, claim_no, place, r.quote_ref, evidence_id, quote, evidence_id IS NOT NULL AS known FROM r LEFT JOIN g ON g.draft_id = r.draft_id AND g.quote_ref = r.quote_ref""")
def resolved_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ref = lambda n: F.concat(F.lit("Q"), F.lpad(n.cast("string"), 3, "0"))
    refs = c.select(F.col("conv_id").alias("draft_id"), F.lit(1).alias("claim_no"), F.col("turn").alias("place"), ref(F.col("turn") % 5).alias("quote_ref"))
    known = c.select(F.col("conv_id").alias("draft_id"), ref(F.col("turn")).alias("quote_ref"), F.concat(F.lit("E"), F.col("turn").cast("string")).alias("evidence_id"), F.md5("text").alias("text"))
    return policy.resolved_quotes(refs, known)


@query("""WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN p = 1 THEN 'Document: Talk ' || conv_id || chr(10) ELSE '' END || CASE WHEN p = 1 OR before != role THEN 'Heading: ' || role || chr(10) ELSE '' END || '[E' || turn || '] ' || text AS line FROM l)
SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS context FROM x GROUP BY 1""")
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").alias("document"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.col("role").alias("heading"), F.concat(F.lit("E"), F.col("turn").cast("string")).alias("label"), "text")
    return policy.rendered_context(c, "conv_id", ["turn"]).select("conv_id", F.md5("context").alias("context"))


_KEPT = "w AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS u FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS u FROM lineitem WHERE l_linenumber <= 4), k AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS u FROM lineitem WHERE l_linenumber <= 3)"


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("unit_id"), "l_returnflag", "l_linenumber")
    return li.where("l_returnflag = 'R'"), li.where("l_linenumber <= 4"), li.where("l_linenumber <= 3")


@query(f"""WITH {_KEPT}, j AS (SELECT w.q, count(*) AS n, count(g.u) AS g, count(CASE WHEN g.u IS NOT NULL THEN k.u END) AS k, count(k.u) AS a FROM w LEFT JOIN g ON g.q = w.q AND g.u = w.u LEFT JOIN k ON k.q = w.q AND k.u = w.u GROUP BY 1),
s AS (SELECT count(*) AS queries, count(*) FILTER (g > 0) AS input_some, count(*) FILTER (g = n) AS input_all, count(*) FILTER (g > 0 AND k > 0) AS kept_some, count(*) FILTER (g = n AND a = n) AS kept_all FROM j) SELECT *, round(kept_some / input_some, 8) AS some_rate, round(kept_all / input_all, 8) AS all_rate FROM s""")
def retention_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.retention_audit(*_kept(spark, sf_dir))


@query(f"WITH {_KEPT} SELECT w.q AS query_id, count(*) AS gold, count(k.u) AS retained, round(count(k.u) / count(*), 8) AS share, count(*) = count(k.u) AS complete FROM w LEFT JOIN k ON k.q = w.q AND k.u = w.u GROUP BY 1")
def gold_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, _, kept = _kept(spark, sf_dir)
    return policy.retention(wanted, kept)


@query(r"""WITH i AS (SELECT item_id, substr(text, 1, 40) AS query, CASE WHEN item_id % 4 = 3 THEN NULL ELSE substr(text, 1, 20 + 10 * (item_id % 4)) END AS answer, item_id % 4 != 3 AS answerable, item_id % 5 > 0 AS base FROM benchmark),
e AS (SELECT item_id, text, item_id % 6 AS grade FROM benchmark WHERE item_id % 7 > 0),
j AS (SELECT i.*, e.text AS source, e.grade, trim(regexp_replace(lower(query), '[^\p{L}\p{N}_]+', ' ', 'g')) AS q, trim(regexp_replace(lower(answer), '[^\p{L}\p{N}_]+', ' ', 'g')) AS a, trim(regexp_replace(lower(e.text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS s,
  list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS w, regexp_extract_all(lower(coalesce(e.text, '')), '[\p{L}\p{N}_]+') AS v FROM i LEFT JOIN e USING (item_id)),
c AS (SELECT count(*) AS items, count(*) FILTER (base) - count(DISTINCT CASE WHEN base THEN q END) AS duplicate_queries, count(*) FILTER (source IS NOT NULL AND grade <= 0) AS empty_evidence,
  count(*) FILTER (CASE WHEN answerable THEN NOT (length(answer) > 0 AND source IS NOT NULL) ELSE length(coalesce(answer, '')) > 0 OR source IS NOT NULL END) AS answerability_errors, count(*) FILTER (regexp_matches(query || chr(10) || coalesce(answer, ''), '[0-9]{9}')) AS personal_data,
  count(*) FILTER (len(list_intersect(w, v)) / len(w) >= 0.5) AS lexical_overlap, count(*) FILTER (answerable AND length(q) >= 12 AND (coalesce(contains(a, q), false) OR coalesce(contains(s, q), false))) AS direct_leakage, 0::BIGINT AS implementation_words FROM j)
SELECT *, duplicate_queries = 0 AND empty_evidence = 0 AND answerability_errors = 0 AND personal_data = 0 AND direct_leakage = 0 AS valid FROM c""")
def validated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    answer = F.when(k % 4 != 3, F.expr("substring(text, 1, int(20 + 10 * (item_id % 4)))"))
    items = b.select("item_id", F.substring("text", 1, 40).alias("query"), answer.alias("answer"), (k % 4 != 3).alias("answerable"), (k % 5 > 0).alias("base"))
    return review.validated_items(items, b.where(k % 7 > 0).select("item_id", "text", (k % 6).alias("grade")), "[0-9]{9}")


@query(r"""WITH v AS (SELECT item_id, ['a', 'b', 'c'][item_id % 3 + 1] AS dialect, trim(regexp_replace(substr(text, 1, 40), '\s+', ' ', 'g')) AS base, CASE item_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'one' || chr(10) || 'two ' || item_id WHEN 2 THEN 'the same' WHEN 3 THEN substr(text, 1, 40) WHEN 4 THEN 'well, ' || substr(text, 1, 40) ELSE 'own ' || item_id END AS text, item_id % 11 > 0 AS marked FROM benchmark),
n AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY item_id) > 1 AS again FROM n)
SELECT item_id AS variant_id, dialect, array_to_string(list_sort(list_filter([CASE WHEN t = '' THEN 'empty_text' END, CASE WHEN item_id % 7 = 1 OR (item_id % 7 IN (3, 4) AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) != '')) > 1) THEN 'multiple_paraphrases_or_concatenation' END,
  CASE WHEN again THEN 'duplicate_variant_text' END, CASE WHEN t = base THEN 'base_identical' END, CASE WHEN item_id % 7 = 4 THEN 'prefix_only_rewrite' END, CASE WHEN NOT marked THEN 'missing_intent_or_qrel_fingerprint' END], lambda x: x IS NOT NULL)), ',') AS reasons,
  NOT (t = '' OR again OR t = base OR item_id % 7 IN (1, 4) OR NOT marked) AS valid FROM r""")
def variant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of benchmark passages with every fault in turn."""
    return _variants(spark, sf_dir).select("variant_id", "dialect", F.array_join("reasons", ",").alias("reasons"), "valid")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    base = F.substring("text", 1, 40)
    text = (
        F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(F.lit("one\ntwo "), k.cast("string"))).when(k % 7 == 2, "the same").when(k % 7 == 3, base)
        .when(k % 7 == 4, F.concat(F.lit("well, "), base)).otherwise(F.concat(F.lit("own "), k.cast("string")))
    )
    mark = F.when(k % 11 > 0, "x")
    return review.variant_faults(b.select(k.alias("variant_id"), k.alias("place"), _pick(("a", "b", "c"), k).alias("dialect"), text.alias("text"), base.alias("base_text"), mark.alias("intent"), mark.alias("qrels")))


@query("WITH a AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY lower(c_mktsegment), c_nationkey ORDER BY c_custkey) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY CAST(floor(c_acctbal / 100) AS BIGINT) ORDER BY c_custkey) = 1) SELECT c_custkey, c_nationkey FROM b")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return review.first_wins(c, ["c_custkey"], F.struct(F.lower("c_mktsegment"), F.col("c_nationkey")), F.floor(F.col("c_acctbal") / 100)).select("c_custkey", "c_nationkey")


@query("SELECT DISTINCT o_orderkey AS query_id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR o_custkey % 40 >= 20")
def hard_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderstatus") == "P").alias("long"), (F.col("o_orderpriority") == "1-URGENT").alias("exact"), (F.col("o_custkey") % 40).alias("rank"))
    return review.hard_queries(o, ["long", "exact"], "rank").select("query_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, c_custkey % 3 = 0 AS touched FROM customer")
def patched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    p = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("X").alias("c_mktsegment"), F.col("c_nationkey"))
    return review.patched(c, p, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("SELECT c_custkey + 100000000 AS c_custkey, 'unknown' AS fault FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'repeated' FROM customer WHERE c_custkey % 5 = 0")
def stray_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    strange = c.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"))
    return review.stray_patches(c, c.unionByName(c.where("c_custkey % 5 = 0")).unionByName(strange), "c_custkey")


_STATES = ("draft", "primary_reviewed", "secondary_reviewed", "adjudicated", "frozen")


@query(f"WITH s AS (SELECT o_orderkey, {_sql_list(_STATES)}[o_orderkey % 5 + 1] AS a, {_sql_list(_STATES)}[o_orderkey % 4 + 2] AS b FROM orders) SELECT o_orderkey, a AS \"from\", b AS \"to\", a = b OR (a, b) IN (('draft', 'primary_reviewed'), ('primary_reviewed', 'secondary_reviewed'), ('primary_reviewed', 'adjudicated'), ('secondary_reviewed', 'adjudicated'), ('adjudicated', 'frozen')) AS allowed FROM s")
def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey")
    return review.transitions(o.withColumn("state", _pick(_STATES, k)), o.withColumn("state", _pick(_STATES[1:], k)), "o_orderkey")


@query("SELECT count(*) AS items, count(*) FILTER (o_orderkey % 5 = 0) AS draft, count(*) FILTER (o_orderkey % 5 > 0) AS primary_reviewed, count(*) FILTER (o_orderkey % 5 >= 2) AS secondary_reviewed, count(*) FILTER (o_orderkey % 3 = 0) AS verified, count(*) FILTER (o_orderkey % 7 = 0) AS disagreements FROM orders")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return review.review_status(table(spark, sf_dir, "orders").select(_pick(_STATES, k).alias("state"), (k % 3 == 0).alias("verified"), (k % 7 == 0).alias("disagreement")))


_OUTCOMES = ("confirmed_failure", "borderline", "uncertain")


@query(f"WITH d AS (SELECT {_sql_list(_OUTCOMES)}[o_orderkey % 3 + 1] AS outcome, o_orderpriority AS cause FROM orders) SELECT outcome, CASE WHEN outcome = 'confirmed_failure' THEN cause END AS cause, count(*) AS n FROM d GROUP BY 1, 2")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_counts(table(spark, sf_dir, "orders").select(_pick(_OUTCOMES, F.col("o_orderkey")).alias("outcome"), F.col("o_orderpriority").alias("cause")))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END) AS same, round(avg(CASE WHEN o_orderstatus = CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END THEN 1 ELSE 0 END), 8) AS rate FROM orders WHERE o_orderkey % 3 = 0")
def suggestion_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cases = o.select(k.alias("case_id"), F.col("o_orderstatus").alias("suggestion"))
    made = o.select(k.alias("case_id"), _pick(_OUTCOMES, k).alias("outcome"), F.when(k % 2 == 0, "F").otherwise("O").alias("cause"))
    return review.agreement(cases, made)


_POPULATIONS = ("answerable_gold_in_top", "answerable_gold_absent", "unanswerable")


@query(f"""WITH r AS (SELECT {_sql_list(_POPULATIONS)}[o_orderkey % 3 + 1] AS p, CASE WHEN o_orderkey % 5 < 2 THEN 'abstain' ELSE 'answer' END AS d, CASE WHEN o_orderkey % 7 = 0 THEN 'abstain' ELSE 'answer' END AS raw, o_orderkey % 4 AS s, o_orderkey % 4 + 1 AS c, o_orderkey % 3 AS g, o_orderkey % 6 AS l, o_orderkey % 2 = 0 AS f FROM orders),
m AS (SELECT unnest([{{'metric': 'supported_answer_precision', 'a': count(*) FILTER (d = 'answer' AND s > 0), 'b': count(*) FILTER (d = 'answer')}}, {{'metric': 'supported_answer_coverage', 'a': count(*) FILTER (d = 'answer' AND s > 0), 'b': count(*) FILTER (p != 'unanswerable')}},
  {{'metric': 'insufficient_context_abstention', 'a': count(*) FILTER (p = 'answerable_gold_absent' AND d = 'abstain'), 'b': count(*) FILTER (p = 'answerable_gold_absent')}}, {{'metric': 'unanswerable_abstention', 'a': count(*) FILTER (p = 'unanswerable' AND d = 'abstain'), 'b': count(*) FILTER (p = 'unanswerable')}},
  {{'metric': 'false_answers', 'a': count(*) FILTER (p = 'unanswerable' AND d = 'answer'), 'b': count(*) FILTER (p = 'unanswerable')}}, {{'metric': 'false_abstentions', 'a': count(*) FILTER (p = 'answerable_gold_in_top' AND d = 'abstain'), 'b': count(*) FILTER (p = 'answerable_gold_in_top')}},
  {{'metric': 'gold_citation_hits', 'a': CAST(sum(g) FILTER (d = 'answer') AS BIGINT), 'b': CAST(sum(c) FILTER (d = 'answer') AS BIGINT)}}, {{'metric': 'claim_citation_coverage', 'a': CAST(sum(l) FILTER (d = 'answer' AND c >= l) AS BIGINT), 'b': CAST(sum(l) FILTER (d = 'answer') AS BIGINT)}},
  {{'metric': 'complete_gold_use', 'a': count(*) FILTER (p = 'answerable_gold_in_top' AND f), 'b': count(*) FILTER (p = 'answerable_gold_in_top')}}, {{'metric': 'rejected_raw_answers', 'a': count(*) FILTER (raw = 'answer' AND d = 'abstain'), 'b': count(*) FILTER (raw = 'answer')}}]) AS x FROM r)
SELECT x.metric AS metric, x.a AS numerator, x.b AS denominator, CASE WHEN x.b > 0 THEN round(x.a / x.b, 8) ELSE 0 END AS value FROM m""")
def outcome_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return review.outcome_metrics(table(spark, sf_dir, "orders").select(
        _pick(_POPULATIONS, k).alias("population"), F.when(k % 5 < 2, "abstain").otherwise("answer").alias("decision"), F.when(k % 7 == 0, "abstain").otherwise("answer").alias("raw_kind"),
        (k % 4).alias("supported"), (k % 4 + 1).alias("citations"), (k % 3).alias("gold_citations"), (k % 6).alias("claims"), (k % 2 == 0).alias("complete"),
    ))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def modality_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.confusion(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


_COUNTS = "c AS (SELECT l_returnflag AS field, l_linenumber % 3 AS tp, l_orderkey % 2 AS fp, l_partkey % 2 AS fn FROM lineitem), s AS (SELECT field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY 1)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("field"), (F.col("l_linenumber") % 3).cast("long").alias("tp"), (F.col("l_orderkey") % 2).alias("fp"), (F.col("l_partkey") % 2).alias("fn"))


@query(f"WITH {_COUNTS}, p AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s) SELECT field, tp, fp, fn, round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS f1 FROM p")
def field_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts_f1(_counts(spark, sf_dir), ["field"])


@query(f"WITH {_COUNTS}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s), p AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM t) SELECT tp, fp, fn, round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS f1 FROM p")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts_f1(_counts(spark, sf_dir), [])


@query(f"WITH {_COUNTS}, k AS (SELECT CASE WHEN fn > 0 AND fp > 0 THEN 'SPAN_BOUNDARY_ERROR' WHEN fn > 0 THEN 'MISSED_EXTRACTION' WHEN fp > 0 THEN 'SPURIOUS_EXTRACTION' END AS kind FROM c) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.error_kinds(_counts(spark, sf_dir))


@query("""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS p, l_returnflag AS m, l_suppkey AS s FROM lineitem), f AS (SELECT l_orderkey AS k, l_linenumber AS p, CASE WHEN l_partkey % 3 = 0 THEN 'X' ELSE l_returnflag END AS m, l_suppkey AS s FROM lineitem WHERE l_linenumber < 6),
e AS (SELECT k, count(*) AS c FROM (SELECT DISTINCT k, m, s FROM g INTERSECT SELECT DISTINCT k, m, s FROM f) GROUP BY 1), n AS (SELECT k, count(*) AS n FROM g GROUP BY 1), o AS (SELECT k, count(*) AS n FROM f GROUP BY 1), a AS (SELECT g.k, avg(CASE WHEN g.m = f.m THEN 1 ELSE 0 END) AS a FROM g JOIN f ON f.k = g.k AND f.p = g.p GROUP BY 1)
SELECT n.k AS l_orderkey, round(coalesce(c, 0) / greatest(n.n, coalesce(o.n, 0), 1), 8) AS exact, round(coalesce(a, 0), 8) AS positional FROM n LEFT JOIN o ON o.k = n.k LEFT JOIN e ON e.k = n.k LEFT JOIN a ON a.k = n.k""")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("modality"), "l_suppkey", "l_partkey")
    found = li.where("place < 6").withColumn("modality", F.when(F.col("l_partkey") % 3 == 0, "X").otherwise(F.col("modality")))
    return review.rule_match(li, found, "l_orderkey", ["modality", "l_suppkey"])


@query("SELECT p_partkey, round((CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + 1) / 3, 8) AS exact, round(1 / 2, 8) AS precision, round(1 / 3, 8) AS recall, round(2 * 0.5 * (1 / 3) / (0.5 + 1 / 3), 8) AS f1 FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, round(2 / 3, 8), 1.0, round(2 / 3, 8), round(2 * 2 / 3 / (1 + 2 / 3), 8) FROM part WHERE p_size % 2 = 0")
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wanted headings of each part against two found ones."""
    p = table(spark, sf_dir, "part")
    gold = F.array(F.col("p_brand"), F.lit("second"), F.lit("third"))
    found = F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "second").otherwise("another"))
    prf = review.set_prf(gold, found)
    return p.select("p_partkey", review.positional_accuracy(gold, found).alias("exact"), prf.alias("s")).select("p_partkey", "exact", "s.*")


@query("WITH p AS (SELECT o_orderkey % 3 = 0 AS b, o_orderkey % 12 = 0 AS a FROM orders), r AS (SELECT count(*) AS n, avg(CAST(b AS INT)) AS b, avg(CAST(a AS INT)) AS a, count(*) FILTER (a != b) AS discordant FROM p) SELECT n, round(b, 8) AS pre, round(a, 8) AS post, round(b - a, 8) AS absolute_reduction, round((b - a) / b, 8) AS relative_reduction, discordant FROM r")
def citation_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return review.counterfactual(table(spark, sf_dir, "orders").select((k % 3 == 0).cast("int").alias("b"), (k % 12 == 0).cast("int").alias("a")), "b", "a")


_SYSTEMS = "m AS (SELECT ['rrf', 'reranked', 'bm25'][o_orderkey % 3 + 1] AS system, o_totalprice / 500000 AS ndcg, (o_custkey % 100) / 100 AS recall, (o_orderkey % 10) / 10 AS complete FROM orders)"


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(_pick(("rrf", "reranked", "bm25"), k).alias("system"), (F.col("o_totalprice") / 500000).alias("ndcg"), (F.col("o_custkey") % 100 / 100).alias("recall"), (k % 10 / 10).alias("complete"))


@query(f"WITH {_SYSTEMS}, a AS (SELECT system, avg(ndcg) AS n, avg(recall) AS r, avg(complete) AS c FROM m GROUP BY 1), d AS (SELECT round(y.n - x.n, 8) AS ndcg_delta, round(y.r - x.r, 8) AS recall_delta, round(y.c - x.c, 8) AS complete_delta FROM a x, a y WHERE x.system = 'rrf' AND y.system = 'reranked') SELECT *, ndcg_delta >= 0.002 AND recall_delta >= -0.01 AND complete_delta >= -0.01 AS eligible, CASE WHEN ndcg_delta >= 0.002 AND recall_delta >= -0.01 AND complete_delta >= -0.01 THEN 'reranked' ELSE 'rrf' END AS selected FROM d")
def rerank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _systems(spark, sf_dir).groupBy("system").agg(*[F.avg(c).alias(c) for c in ("ndcg", "recall", "complete")])
    return review.rerank_gate(m, "rrf", "reranked")


@query(f"WITH {_SYSTEMS}, u AS (SELECT system, 'ndcg' AS metric, ndcg AS v FROM m UNION ALL SELECT system, 'recall', recall FROM m), a AS (SELECT system, metric, count(*) AS n, avg(v) AS a FROM u GROUP BY 1, 2) SELECT a.system, a.metric, a.n, round(a.a, 8) AS mean, round(a.a - b.a, 8) AS delta FROM a JOIN a b ON b.metric = a.metric AND b.system = 'bm25'")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _systems(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("ndcg", "recall")])).alias("x")
    return review.run_summary(m.select("system", each).select("system", "x.*"), "system", "v", "bm25")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unchanged_control' WHEN o_orderkey % 2 = 1 THEN 'harness_or_perturbation_defect' WHEN o_orderkey % 3 = 0 THEN 'redundant_or_tokenizer_insensitive' WHEN o_orderkey % 5 = 0 THEN 'harness_or_perturbation_defect'
  WHEN o_orderkey % 11 = 0 THEN 'rank_or_top10_change' WHEN o_orderkey % 13 = 0 THEN 'score_change_no_rank_change' ELSE 'harness_or_perturbation_defect' END AS class FROM orders""")
def sensitivity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    got = review.sensitivity_class(F.when(k % 7 == 0, "unchanged_control").otherwise("digit"), k % 2 == 0, k % 3 > 0, k % 5 > 0, k % 13 == 0, k % 11 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("class"))


@query("SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'present_untrusted' ELSE 'missing_targeted_acquisition' END AS status, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 THEN 'authoritative_article_count_and_manual_samples' ELSE 'official_machine_readable_source_or_manual_authority_record' END AS need FROM nation")
def source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select("n_name", F.when((k % 2 == 0) | (k % 3 == 0), F.concat(F.lit("law "), k.cast("string"))).alias("target_law"), k.alias("key"))
    known = n.where("key % 3 = 0").select(F.col("target_law").alias("law"), F.lit("seen").alias("status"))
    return review.source_gaps(n, known, "n_name", "target_law")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey AS VARCHAR) AS pages FROM part")
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("انظر صفحة "), F.col("p_size").cast("string"), F.lit(" ثم ص "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(review.page_references(text), ",").alias("pages"))


@query("SELECT o_orderkey, o_orderkey % 3 < 2 AS answered, CASE WHEN 8000 - o_custkey * 10 > 0 THEN 8000 - o_custkey * 10 END AS budget FROM orders")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = policy.answer_gate(_pick(("both", "sparse-only", "dense-only"), F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("answered"), policy.evidence_budget(8192, F.col("o_custkey") * 10, 192).alias("budget"))
