"""Queries of identifiers, extraction, statutes, integrity and the registry of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import build, extraction, identity, labels, quality, review, sampling
from tamarisk.queries.retrieval import _TOKENS
from tamarisk.queries.tables import corpus, spread, table
from tamarisk.registry import query
from tamarisk.sources import registry as sources


def _uuid(name: str) -> str:
    h = f"sha1(unhex('{identity.NAMESPACE}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


@query(f"SELECT p_partkey, {_uuid(chr(39) + 'unit|s|v1|part|' + chr(39) + ' || p_partkey || ' + chr(39) + '|p_name' + chr(39))} AS record_id FROM part")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    return table(spark, sf_dir, "part").select("p_partkey", identity.record_id(lit("s"), lit("v1"), lit("part"), F.col("p_partkey"), lit("p_name")).alias("record_id"))


@query("""WITH i AS (SELECT p_partkey, 'fixed:' || substr(sha256('{"policy_hash":"","source_identity":"' || p_partkey || '","spans":[{"end":' || p_size || ',"start":0,"unit_id":"u' || p_partkey || '"}],"strategy_id":"fixed"}'), 1, 32) AS chunk_id,
  'intent-' || substr(sha256('{"category":"' || p_brand || '","documents":["a","b' || p_size || '"],"span":["u' || p_partkey || '"]}'), 1, 24) AS intent_id FROM part)
SELECT *, 'query-' || substr(sha256(intent_id || ':base'), 1, 24) AS query_id, 'query-' || substr(sha256(intent_id || ':v1'), 1, 24) AS variant_id FROM i""")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    spans = F.array(F.struct(unit.alias("unit_id"), F.lit(0).alias("start"), F.col("p_size").alias("end")))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", identity.chunk_id(F.lit("fixed"), F.col("p_partkey").cast("string"), spans).alias("chunk_id"),
        identity.intent_id(F.col("p_brand"), F.array(F.concat(F.lit("b"), F.col("p_size").cast("string")), F.lit("a")), F.array(unit)).alias("intent_id"),
    )
    return rows.withColumn("query_id", identity.query_id(F.col("intent_id"))).withColumn("variant_id", identity.query_id(F.col("intent_id"), F.lit("v1")))


_SENTENCE = ("خلال ", " يوما بدفع ", " ريال وفق المادة (", ") بتاريخ 12/3/1440هـ")


@query(f"""WITH t AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS n, CAST(p_partkey AS VARCHAR) AS m, length('{_SENTENCE[0]}') AS a FROM part),
p AS (SELECT *, a + length(n) + length('{_SENTENCE[1]}') AS b, a + length(n) + length('{_SENTENCE[1]}') + length(m) + length(' ريال وفق ') AS c FROM t),
r AS (SELECT k, 'duration' AS kind, 'temporal' AS type, 'T001' AS label, a AS start, n || ' يوما' AS raw, n || ' day' || CASE WHEN n = '1' THEN '' ELSE 's' END AS value, NULL AS calendar FROM p
UNION ALL SELECT k, 'money', 'monetary', 'M001', b, m || ' ريال', m || ' SAR', NULL FROM p
UNION ALL SELECT k, 'article', 'article', 'A001', c, 'المادة (' || n || ')', n, NULL FROM p
UNION ALL SELECT k, 'date', 'temporal', 'T002', c + length('المادة (' || n || ')') + length(' بتاريخ '), '12/3/1440هـ', '1440-03-12', 'hijri' FROM p)
SELECT k AS doc_id, kind, type, label, start, start + length(raw) AS "end", raw, value, 'normalized' AS status, calendar FROM r""")
def extract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in a sentence made of each part's size and key."""
    a, b, c, d = map(F.lit, _SENTENCE)
    n = F.col("p_size").cast("string")
    text = F.concat(a, n, b, F.col("p_partkey").cast("string"), c, n, d)
    rows = extraction.candidates(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return rows.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@query(f"SELECT p_partkey AS doc_id, sha256('{_SENTENCE[0]}' || p_size || '{_SENTENCE[1]}' || p_partkey || '{_SENTENCE[2]}' || p_size || '{_SENTENCE[3]}') AS fingerprint, 4::BIGINT AS n, 'A001' AS articles, '' AS regulations FROM part")
def extraction_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = map(F.lit, _SENTENCE)
    n = F.col("p_size").cast("string")
    text = F.concat(a, n, b, F.col("p_partkey").cast("string"), c, n, d)
    rows = extraction.extracted(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", "fingerprint", F.size("candidates").cast("long").alias("n"), F.array_join("articles", ",").alias("articles"), F.array_join("regulations", ",").alias("regulations"))


_LAWS = "l AS (SELECT l_orderkey AS law, l_suppkey * 1000000 + l_partkey * 10 + l_linenumber AS line, CAST(l_linenumber % 3 + 1 AS BIGINT) AS n, l_returnflag AS text FROM lineitem)"


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    label = F.concat(F.lit("المادة "), (F.col("l_linenumber") % 3 + 1).cast("string"))
    return li.select(F.col("l_orderkey").alias("law"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line"), label.alias("label"), F.col("l_returnflag").alias("text"))


@query(f"""WITH {_LAWS}, g AS (SELECT law, n AS a, count(*) AS n, count(DISTINCT text) AS t, max(line) - min(line) + 1 = count(DISTINCT line) AS consecutive FROM l GROUP BY law, a)
SELECT law, 'article:' || a || '|label:' || a || '|status:' AS key, n, CASE WHEN n = 1 THEN 'unique' WHEN t > 1 THEN 'conflicting_duplicate' ELSE 'unresolved' END AS status, consecutive,
CASE WHEN n = 1 THEN NULL WHEN consecutive AND t > 1 THEN 'ambiguous_continuation_candidate' ELSE 'genuine_conflict_candidate' END AS review FROM g""")
def article_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.article_groups(_laws(spark, sf_dir), "law", "line", "label", "text")


@query(f"WITH {_LAWS} SELECT law, count(*) AS n, count(*) AS understood, 0::BIGINT AS unresolved, count(DISTINCT n) AS ordinals, 0::BIGINT AS ordinals_with_several_keys FROM l GROUP BY law")
def law_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.law_figures(_laws(spark, sf_dir), "law", "label")


@query(f"""WITH {_LAWS}, g AS (SELECT law, n, count(*) AS c FROM l GROUP BY 1, 2), d AS (SELECT law, bool_and(c = 1) AS u, CAST(sum(c) AS BIGINT) AS units FROM g GROUP BY 1), f AS (SELECT law, min(line) AS first FROM l GROUP BY 1),
i AS (SELECT law, units, u, 'statute|s|v1|laws|' || first || '|law_name' AS name FROM d JOIN f USING (law))
SELECT {_uuid('name')} AS document_id, law, units, CASE WHEN u THEN 'unique' ELSE 'unresolved' END AS status FROM i""")
def statute_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.statute_documents(_laws(spark, sf_dir), "s", "v1", "laws", "law", "line", "label", "text")


@query(f"""WITH {_LAWS}, o AS (SELECT *, row_number() OVER (PARTITION BY law ORDER BY line) AS ordinal FROM l), i AS (SELECT *, 'unit|s|v1|laws|' || line || '|text' AS name FROM o)
SELECT {_uuid('name')} AS unit_id, law, ordinal, n AS article, text FROM i""")
def statute_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.statute_units(_laws(spark, sf_dir), "s", "v1", "laws", "law", "line", "label", "text")
    return rows.select("unit_id", "law", F.col("ordinal").cast("long").alias("ordinal"), F.col("article").cast("long").alias("article"), "text")


@query("SELECT 1000::BIGINT AS expected, (SELECT count(*) FROM lineitem) AS accounted, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS documents, (SELECT count(*) FROM lineitem) AS units, 0::BIGINT AS excluded, (SELECT count(*) FROM lineitem) = 1000 AS complete")
def build_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _laws(spark, sf_dir)
    return build.accounting(1000, raw, raw.select("law").distinct(), raw)


@query("SELECT l_orderkey AS law, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_suppkey * 1000000 + l_partkey * 10 + l_linenumber) AS texts FROM lineitem GROUP BY 1")
def documents_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.grouped_units(_laws(spark, sf_dir).drop("label"), "law", "line", "text")
    return rows.select("law", F.size("units").cast("long").alias("n"), F.array_join(F.transform("units", lambda u: u["text"]), ",").alias("texts"))


@query(f"""WITH t AS MATERIALIZED (SELECT text AS x, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS y FROM conversations),
k AS MATERIALIZED (SELECT x, y, array_to_string({_TOKENS.replace('(text', '(x')}, chr(31)) AS xt, array_to_string({_TOKENS.replace('(text', '(y')}, chr(31)) AS yt FROM t),
r AS (SELECT x, y, CASE WHEN length(x) = 0 THEN 0 ELSE (greatest(length(x), length(y)) - len(list_filter(list_zip(string_split(x, ''), string_split(y, '')), lambda p: p[1] = p[2]))) / greatest(length(x), length(y)) END AS c,
  CASE WHEN length(xt) = 0 THEN 0 ELSE (greatest(length(xt), length(yt)) - len(list_filter(list_zip(string_split(xt, ''), string_split(yt, '')), lambda p: p[1] = p[2]))) / greatest(length(xt), length(yt)) END AS d FROM k),
f AS (SELECT y, count(*) AS n, count(DISTINCT x) AS raw FROM t GROUP BY y)
SELECT count(*) AS units, round(avg(c), 8) AS character_change, round(avg(d), 8) AS token_change, 0.0::DOUBLE AS vocabulary_compression,
  (SELECT count(*) FROM f WHERE raw > 1) AS collision_groups, round((SELECT avg(CASE WHEN raw > 1 THEN 1 ELSE 0 END) FROM f), 8) AS form_collision_rate, round((SELECT sum(CASE WHEN raw > 1 THEN n ELSE 0 END) / sum(n) FROM f), 8) AS unit_collision_rate FROM r""")
def policy_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.policy_diagnosis(table(spark, sf_dir, "conversations"), "text", "raw")


@query(r"""WITH t AS MATERIALIZED (SELECT text AS x, trim(regexp_replace(text, '\s+', ' ', 'g')) AS y FROM conversations), f AS (SELECT y, count(DISTINCT x) AS raw FROM t GROUP BY y), c AS (SELECT round(avg(CASE WHEN raw > 1 THEN 1 ELSE 0 END), 8) AS collisions FROM f)
SELECT (SELECT count(*) FROM t) AS units, 0::BIGINT AS unsettled, 0::BIGINT AS unsafe, collisions, collisions <= 0.01 AS eligible FROM c""")
def normal_form_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.normal_form_gate(table(spark, sf_dir, "conversations"), "text", "raw")


_CHUNKS = """c AS (SELECT p_partkey AS k, p_name AS t, length(p_name) AS n, length(p_name) // 2 AS h FROM part)"""


@query(rf"""WITH {_CHUNKS}, s AS (SELECT k, t, 0 AS a, h AS b FROM c UNION ALL SELECT k, t, h, n FROM c WHERE k % 7 > 0 UNION ALL SELECT k, t, h, n + 5 FROM c WHERE k % 7 = 0),
v AS (SELECT length(regexp_replace(substr(t, a + 1, b - a), '\s', '', 'g')) AS x FROM s WHERE b <= length(t) AND b > a)
SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c WHERE k % 11 = 0) AS orphans, (SELECT count(*) FROM s WHERE b > length(t) OR b <= a) AS invalid_spans, (SELECT count(*) FROM c WHERE k % 5 = 0) AS display_mismatches,
  0::BIGINT AS cross_section, 0::BIGINT AS boundary_violations, round((SELECT sum(x) FROM v) / (SELECT sum(length(regexp_replace(t, '\s', '', 'g'))) FROM c), 8) AS coverage""")
def chunk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name as two spans of one chunk, with faults in some."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"), F.length("p_name").alias("n")).withColumn("h", F.expr("int(n div 2)"))
    last = F.when(F.col("k") % 7 == 0, F.col("n") + 5).otherwise(F.col("n"))
    spans = p.select(F.col("k").alias("chunk_id"), F.lit(0).alias("place"), F.col("k").alias("unit_id"), F.lit(0).alias("start"), F.col("h").alias("end"))
    spans = spans.unionByName(p.select(F.col("k").alias("chunk_id"), F.lit(1).alias("place"), F.col("k").alias("unit_id"), F.col("h").alias("start"), last.alias("end")))
    display = F.concat(F.expr("substring(t, 1, h)"), F.lit("\n"), F.expr("substring(t, h + 1, n - h)"), F.when(F.col("k") % 5 == 0, "!").otherwise(""))
    chunks = p.select(F.col("k").alias("chunk_id"), F.when(F.col("k") % 11 == 0, -1 - F.col("k")).otherwise(F.col("k")).alias("parent_id"), F.lit(False).alias("fixed"), display.alias("display"))
    nodes = p.select(F.col("k").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.col("k").alias("unit_id"))
    return build.chunk_faults(chunks, spans, p.select(F.col("k").alias("unit_id"), F.col("t").alias("text")), nodes)


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND n_chars = 0 THEN 'image_only' WHEN doc_id % 3 > 0 THEN 'mixed_image_text' WHEN n_chars / 100000 > 0.01 THEN 'dense_text' ELSE 'sparse_text' END AS label FROM documents")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", build.page_label(F.col("n_chars"), F.col("doc_id") % 3, F.lit(100000.0)).alias("label"))


@query("SELECT dimension, value, count(*) AS n FROM (SELECT 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.registry_summary(table(spark, sf_dir, "documents"), ("lang", "source"))


@query("""WITH r AS (SELECT 'src' || (o_orderkey % 30) AS source_id, ['inspect', 'train', 'acquire', 'parse'][o_orderkey % 4 + 1] AS operation, ['local_parsing', 'training', 'integrity'][o_orderkey % 3 + 1] AS purpose, o_orderkey FROM orders), k AS (SELECT DISTINCT source FROM documents),
a AS (SELECT *, CASE WHEN purpose = 'training' OR operation = 'train' THEN 'training, publishing, display and demo are denied' WHEN source_id NOT IN (SELECT source FROM k) THEN 'the source isn''t registered'
  WHEN source_id NOT IN ('src1', 'src2') THEN 'no acquisition is authorised for this source' WHEN (operation IN ('inspect', 'acquire') AND (source_id = 'src1' OR purpose = 'integrity')) OR (operation = 'parse' AND purpose = 'local_parsing') THEN 'authorised' ELSE 'operation and purpose aren''t authorised for this source' END AS reason FROM r)
SELECT source_id, operation, purpose, reason = 'authorised' AS allowed, reason FROM a""")
def acquisition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("src"), (k % 30).cast("string")).alias("source_id"), pick(("inspect", "train", "acquire", "parse"), 4).alias("operation"), pick(("local_parsing", "training", "integrity"), 3).alias("purpose"))
    known = corpus(spark, sf_dir).select(F.col("source").alias("source_id"))
    return sources.authorised(asked, known, {"src1": ("local_parsing", "integrity"), "src2": ("integrity",)})


@query("WITH k AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) AS p FROM k) SELECT d.doc_id, d.lang, d.source FROM documents d JOIN r USING (lang, source) WHERE p <= 3")
def first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the three first sources of each language."""
    rows = sampling.first_per_group(corpus(spark, sf_dir), "lang", "source", 3)
    return rows.where("not short").select("doc_id", "lang", "source")


@query("""WITH v AS (SELECT doc_id AS key, 'space' AS phenomenon, 0 AS i, CASE WHEN contains(text, ' ') THEN sha256(substr(text, 1, strpos(text, ' ') - 1) || '  ' || substr(text, strpos(text, ' ') + 1)) END AS query FROM documents
  UNION ALL SELECT doc_id, 'bom', 1, CASE WHEN length(text) > 0 THEN sha256(chr(65279) || text) END FROM documents),
p AS (SELECT phenomenon, key, query, i, row_number() OVER (PARTITION BY phenomenon ORDER BY sha256('7:' || phenomenon || ':' || key), key) - 1 AS place FROM v WHERE query IS NOT NULL)
SELECT phenomenon, key, query, place FROM p WHERE place < CASE WHEN i = 0 THEN 13 ELSE 12 END""")
def challenge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five disturbed texts: a sampling operator."""
    from tamarisk.operators.analysis import perturbations

    p = perturbations(F.col("text"))
    rows = sampling.challenge(corpus(spark, sf_dir), "doc_id", {"space": p["double_space"], "bom": p["bom"]}, 25, 7)
    return rows.select("phenomenon", "key", F.sha2("query", 256).alias("query"), F.col("place").cast("long").alias("place"))


@query(rf"""WITH t AS MATERIALIZED (SELECT item_id AS key, {_TOKENS} AS t FROM benchmark), w AS (SELECT key, unnest(t) AS w, unnest(range(len(t))) AS pos FROM t),
f AS (SELECT w, count(*) AS f FROM w WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]') GROUP BY w), r AS (SELECT key, pos, w.w, 1 / f AS r FROM w LEFT JOIN f ON f.w = w.w),
n AS (SELECT key, len(t) AS n FROM t), p AS (SELECT DISTINCT key, n, unnest([0, n // 4, n // 2, 3 * n // 4, n - 1]) AS p FROM n), c AS (SELECT key, n, p, unnest(range(2, 9)) AS width FROM p),
s AS (SELECT DISTINCT key, width, greatest(0, least(p - width // 2, n - width)) AS start FROM c WHERE width <= n),
x AS (SELECT s.key, width, start, round(sum(coalesce(r.r, 0.0::DOUBLE) ORDER BY pos), 10) AS rarity, count(r.r) AS words, string_agg(r.w, ' ' ORDER BY pos) AS "window" FROM s JOIN r ON r.key = s.key AND pos >= start AND pos < start + width GROUP BY 1, 2, 3)
SELECT key, start, width, rarity, "window" FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY rarity DESC, words DESC, start, width DESC, "window" DESC) = 1""")
def rare_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.rare_windows(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.select("key", F.col("start").cast("long").alias("start"), F.col("width").cast("long").alias("width"), "rarity", "window")


@query(rf"WITH w AS MATERIALIZED (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / len(a.w), 8) AS share, len(list_intersect(a.w, b.w)) / len(a.w) >= 0.5 AS half FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a passage's words that the next one has."""
    w = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.lower("text")).alias("w"))
    nxt = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    share = T.overlap_of(F.col("w"), F.col("v"))
    return w.join(nxt, "item_id").select("item_id", F.round(share, 8).alias("share"), (share >= 0.5).alias("half"))
