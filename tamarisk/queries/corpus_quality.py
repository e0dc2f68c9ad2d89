"""Quality, privacy, metadata and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators import quality, sampling
from tamarisk.queries.tables import corpus, table
from tamarisk.registry import query


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest FROM g")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_figures(corpus(spark, sf_dir), ["text", "lang"])


@query("SELECT text, lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text, lang FROM documents WHERE doc_id % 2 = 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a train and a test half (even and odd ids, together the whole table) share."""
    d = corpus(spark, sf_dir)
    return quality.split_overlap(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text", "lang"])


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir)
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


_PII = r"""
SELECT doc_id, 'text' AS column, detector, '[REDACTED]' AS masked FROM (
  SELECT doc_id, 'email' AS detector FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
  UNION ALL SELECT doc_id, 'phone' FROM documents WHERE regexp_matches(text, '(?:^|[^0-9A-Za-z])(\+?[0-9][0-9 ()\-]{7,}[0-9])(?:$|[^0-9A-Za-z])')
  UNION ALL SELECT doc_id, 'iban' FROM documents WHERE regexp_matches(text, '(?:^|[^0-9A-Za-z])([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?:$|[^0-9A-Za-z])'))"""


@query(_PII)
def pii_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.privacy_findings(corpus(spark, sf_dir), "doc_id", ["text"])


@query(f"SELECT detector, count(*) AS findings, count(DISTINCT doc_id) AS rows_hit FROM ({_PII}) GROUP BY 1")
def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_screen(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("rows_hit"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g'),
  '(^|[^0-9A-Za-z])([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})($|[^0-9A-Za-z])', '\1[REDACTED]\3', 'g'),
  '(^|[^0-9A-Za-z])(\+?[0-9][0-9 ()\-]{7,}[0-9])($|[^0-9A-Za-z])', '\1[REDACTED]\3', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", quality.redacted(F.col("text")).alias("text"))


@query(r"""SELECT count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank_text, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS blank_lang,
  count(*) FILTER (source IS NULL OR trim(source) = '') AS blank_source, count(DISTINCT text) AS distinct_texts, count(*) FILTER (length(text) < 20) AS shorter_than_20,
  count(*) FILTER (length(text) > 10000) AS longer_than_10000, count(*) FILTER (len(regexp_extract_all(text, '\p{L}')) < 0.2 * length(text)) AS few_letters,
  count(*) FILTER (contains(text, chr(65533))) AS with_replacement_character FROM documents""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_profile(corpus(spark, sf_dir), "text", ["lang", "source"])


@query(r"""SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS form, count(*) AS units, count(DISTINCT sha256(text)) AS raw_forms FROM (SELECT text FROM documents UNION ALL SELECT replace(text, ' ', '  ') FROM documents WHERE doc_id % 10 = 0)
GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1 ORDER BY units DESC, form LIMIT 10""")
def collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and, beside some, the same with wider spaces."""
    d = corpus(spark, sf_dir).select("doc_id", "text")
    wider = d.where("doc_id % 10 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    return quality.collision_groups(d.unionByName(wider), "doc_id", "text", "aggressive")


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, and beside each a copy and one with its last letters changed."""
    return quality.near_duplicate_texts(passages_thrice(spark, sf_dir), "item_id", "text")


def passages_thrice(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    changed = F.concat(F.expr("left(text, length(text) - 3)"), F.lit("xyz"))
    return b.unionByName(b.select((F.col("item_id") + 100_000).alias("item_id"), "text")).unionByName(b.select((F.col("item_id") + 200_000).alias("item_id"), changed.alias("text")))


@query("WITH t AS (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 100000, text FROM benchmark UNION ALL SELECT item_id + 200000, left(text, length(text) - 3) || 'xyz' FROM benchmark) SELECT item_id AS key, min(item_id) OVER (PARTITION BY text) AS class FROM t WHERE length(text) > 0")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_classes(passages_thrice(spark, sf_dir), "item_id", "text")


_META = "orders JOIN customer ON o_custkey = c_custkey"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


@query(f"SELECT o_orderkey, c_mktsegment, o_orderstatus FROM {_META} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus IN ('O', 'F') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = quality.metadata_filter({"c_mktsegment": ["BUILDING", "MACHINERY"], "o_orderstatus": ["O", "F"]}, {"o_orderdate": ("1995-01-01", "1996-12-31")})
    return _orders(spark, sf_dir).where(ok).select("o_orderkey", "c_mktsegment", "o_orderstatus")


@query(f"""SELECT field, count(v) AS populated, count(*) - count(v) AS missing, round(count(v) / count(*), 6) AS share, count(DISTINCT v) AS distinct_values FROM (
  SELECT 'c_mktsegment' AS field, nullif(c_mktsegment, '') AS v FROM {_META} UNION ALL SELECT 'o_orderstatus', nullif(o_orderstatus, '') FROM {_META} UNION ALL SELECT 'o_orderpriority', nullif(o_orderpriority, '') FROM {_META}) GROUP BY 1""")
def metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(_orders(spark, sf_dir), ["c_mktsegment", "o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT o_totalprice < 300000 THEN 'price_in_range' END, CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'settled' END]) AS rule FROM orders) WHERE rule IS NOT NULL")
def record_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"price_in_range": F.col("o_totalprice") < 300000, "settled": F.col("o_orderstatus").isin("O", "F")}
    return quality.violations(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query("SELECT c_custkey FROM customer ORDER BY sha256('7:' || c_custkey), c_custkey LIMIT 20")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_top(table(spark, sf_dir, "customer"), "c_custkey", 20, 7).select("c_custkey")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
i AS (SELECT unnest(range(5)) AS i) SELECT source, doc_id FROM r WHERE n <= 5 OR EXISTS (SELECT 1 FROM i WHERE r.r = (i.i * (r.n - 1)) // 4)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_sample(corpus(spark, sf_dir), ["source"], "doc_id", 5).select("source", "doc_id")


@query("""WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('11:' || c_custkey), c_custkey) AS round FROM customer)
SELECT *, row_number() OVER (ORDER BY round, c_mktsegment) AS place FROM r ORDER BY round, c_mktsegment LIMIT 32""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 32, 11)


@query("""WITH s AS (SELECT source, count(*) AS available FROM documents GROUP BY 1), e AS (SELECT *, 100 * available / sum(available) OVER () AS e FROM s),
f AS (SELECT *, floor(e) AS f, 100 - sum(floor(e)) OVER () AS rest, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, source) AS rank FROM e)
SELECT source, available, CAST(least(f + CASE WHEN rank <= rest THEN 1 ELSE 0 END, available) AS BIGINT) AS quota FROM f""")
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas(corpus(spark, sf_dir), "source", 100)


@query("SELECT doc_id, source, round((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / count(*) OVER (PARTITION BY source), 9) AS share FROM documents")
def proportional_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.interleaved(corpus(spark, sf_dir), "source", "doc_id").select("doc_id", "source", "share")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.7, 0))) THEN 'dev' ELSE 'holdout' END AS split FROM r""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(corpus(spark, sf_dir), "lang", "doc_id").select("doc_id", "lang", "split")


@query("WITH c AS (SELECT quantile_disc(n_chars, 1/3) AS a, quantile_disc(n_chars, 2/3) AS b FROM documents) SELECT doc_id, CASE WHEN n_chars <= a THEN 'short' WHEN n_chars <= b THEN 'medium' ELSE 'long' END AS bin FROM documents, c")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.length_bins(table(spark, sf_dir, "documents"), "n_chars").select("doc_id", "bin")




@query()
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts linked by line items, split by whole components."""
    li = table(spark, sf_dir, "lineitem")
    return sampling.component_split(li.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


@query("""WITH RECURSIVE members AS (SELECT s_nationkey AS g, s_suppkey AS v FROM supplier),
sizes AS (SELECT count(*) + 1 AS n, row_number() OVER (ORDER BY g) AS i FROM members GROUP BY g),
sums AS (SELECT 0::BIGINT AS i, 0::BIGINT AS total UNION SELECT z.i, s.total + t.take FROM sums s JOIN sizes z ON z.i = s.i + 1, LATERAL (SELECT unnest([0, z.n]) AS take) t),
goal AS (SELECT sum(n) AS vertices, CAST(round_even(sum(n) / 3, 0) AS BIGINT) AS target FROM sizes)
SELECT CAST(vertices AS BIGINT) AS vertices, (SELECT total FROM sums WHERE i = (SELECT max(i) FROM sizes) ORDER BY abs(total - target), total LIMIT 1) AS test FROM goal""")
def split_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers linked by their nation, split by whole nations: how many vertices there are, and how many of them are test."""
    s = table(spark, sf_dir, "supplier")
    parts = sampling.component_split(s.select((F.col("s_suppkey") * 2).cast("long").alias("a"), (F.col("s_nationkey") * 2 + 1).cast("long").alias("b")))
    return parts.agg(F.count("*").alias("vertices"), F.count_if(F.col("split") == "test").alias("test"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS raw, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS aggressive_sha FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir)
    text = T.composed(F.col("text"))
    return d.select("doc_id", text.alias("text")).select("doc_id", T.normalised(F.col("text"), "raw").alias("raw"), F.sha2(T.normalised(F.col("text"), "aggressive"), 256).alias("aggressive_sha"))


@query(r"""WITH t AS (SELECT doc_id, text AS x, repeat('ـ', doc_id % 2) || repeat('َ', doc_id % 3) || repeat('أ', doc_id % 4) || repeat('ة', doc_id % 5) || repeat('٣', doc_id % 6) || repeat('؟', doc_id % 7) || text AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(x, chr(65279))) AS bom_removed,
  CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) != text THEN len(regexp_extract_all(text, '\s')) ELSE 0 END AS whitespace_mapped,
  doc_id % 2 AS tatweel_removed, doc_id % 3 AS diacritics_removed, doc_id % 4 AS alef_mapped, doc_id % 5 AS letters_mapped, doc_id % 6 AS digits_mapped,
  doc_id % 7 + len(regexp_extract_all(x, '[،؛؟٪٫٬“”]')) AS punctuation_mapped FROM t""")
def transform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document behind so many letters of each kind as its key tells."""
    some = [F.repeat(F.lit(c), (F.col("doc_id") % n).cast("int")) for c, n in (("ـ", 2), ("َ", 3), ("أ", 4), ("ة", 5), ("٣", 6), ("؟", 7))]
    d = corpus(spark, sf_dir).select("doc_id", F.concat(*some, "text").alias("text"))
    return d.select("doc_id", *[c.cast("long").alias(k) for k, c in T.transform_counts(F.col("text")).items()])
