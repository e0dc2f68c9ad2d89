"""Queries that hold tables against each other and against rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import annotation, reconcile, sampling
from tamarisk.plans.lineage import fresh_folder
from tamarisk.queries.tables import QUERY_ROWS, table
from tamarisk.registry import query
from tamarisk.sources.cache import cached


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and what a replay makes of them from their lines: totals by lines, an order's dates, and every kind of fault."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    moved = orders.where("o_orderkey % 13 != 0").withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 0.004).when(F.col("o_orderkey") % 7 == 0, 1.5).otherwise(0.0)
    ).withColumn("o_orderstatus", F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderstatus")))
    extra = orders.where("o_orderkey % 17 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    again = moved.where("o_orderkey % 19 = 0")
    return orders, moved.unionByName(extra).unionByName(again)


@query("""WITH l AS (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS p, o_orderstatus AS s FROM orders),
m AS (SELECT o_orderkey, o_custkey, p + CASE WHEN o_orderkey % 5 = 0 THEN 0.004 WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE 0.0 END AS p, CASE WHEN o_custkey % 11 != 0 THEN s END AS s FROM l WHERE o_orderkey % 13 != 0),
r AS (SELECT * FROM m UNION ALL SELECT -o_orderkey, o_custkey, p, s FROM l WHERE o_orderkey % 17 = 0 UNION ALL SELECT * FROM m WHERE o_orderkey % 19 = 0),
a AS (SELECT o_orderkey, count(*) AS n, any_value(p) AS p, any_value(s) AS s FROM l GROUP BY 1), b AS (SELECT o_orderkey, count(*) AS n, any_value(p) AS p, any_value(s) AS s FROM r GROUP BY 1),
x AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.n AS ln, b.n AS rn, a.p AS lp, b.p AS rp, a.s AS ls, b.s AS rs FROM a FULL JOIN b USING (o_orderkey))
SELECT o_orderkey, 'only_left' AS kind, NULL::VARCHAR AS "column" FROM x WHERE rn IS NULL
UNION ALL SELECT o_orderkey, 'only_right', NULL FROM x WHERE ln IS NULL
UNION ALL SELECT o_orderkey, 'repeated_right', NULL FROM x WHERE rn > 1
UNION ALL SELECT o_orderkey, 'value_differs', 'o_totalprice' FROM x WHERE ln = 1 AND rn = 1 AND abs(lp - rp) > 0.01
UNION ALL SELECT o_orderkey, 'value_missing_right', 'o_orderstatus' FROM x WHERE ln = 1 AND rn = 1 AND ls IS NOT NULL AND rs IS NULL""")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _replayed(spark, sf_dir)
    return reconcile.differences(left, right, ["o_orderkey"], {"o_totalprice": 0.01}).select("o_orderkey", "kind", "column")


@query("SELECT doc_id, len(string_split(CASE WHEN doc_id % 10 = 0 THEN text || ' anew' ELSE text END, ' ')) AS words, doc_id % 10 = 0 AS rebuilt FROM documents")
def context_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text, kept by content; then some texts change, and only theirs are counted again."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_folder(spark, "contexts")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" anew"))).otherwise(F.col("text")))
    for texts in (docs, later):
        counted = lambda todo, texts=texts: todo.join(texts, "doc_id").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("words"))
        results, marks = cached(docs.select("doc_id"), "doc_id", {"texts": texts}, path, {"by": "space"}, counted)
    return results.join(marks, "doc_id")


@query("""WITH r AS (SELECT doc_id AS record_id, 'u' || doc_id AS unit_id, CASE WHEN lang = 'fr' THEN 'done' WHEN lang = 'de' THEN 'in_review' ELSE 'reviewed' END AS status,
  CASE WHEN source = 'src1' THEN 'dual_ai_agreed' ELSE 'person' END AS origin, quality = 1 AS verified, text, CASE WHEN n_chars > 5000 THEN left(text, 5000) ELSE text END AS registry_text FROM documents JOIN labels USING (doc_id)),
s AS (SELECT 'u' || doc_id AS unit_id FROM labels WHERE toxic = 0)
SELECT record_id, violation FROM (SELECT record_id, unnest([CASE WHEN unit_id NOT IN (SELECT unit_id FROM s) THEN 'unit_not_selected' END, CASE WHEN status = 'done' THEN 'invalid_status' END,
  CASE WHEN verified AND origin = 'dual_ai_agreed' THEN 'machine_review_verified' END, CASE WHEN verified AND status != 'reviewed' THEN 'verified_not_reviewed' END,
  CASE WHEN text != registry_text THEN 'registry_text_differs' END]) AS violation FROM r) WHERE violation IS NOT NULL""")
def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    unit, status = F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.when(F.col("lang") == "fr", "done").when(F.col("lang") == "de", "in_review").otherwise("reviewed")
    records = rows.select(F.col("doc_id").alias("record_id"), unit.alias("unit_id"), status.alias("status"), F.when(F.col("source") == "src1", "dual_ai_agreed").otherwise("person").alias("origin"),
                          (F.col("quality") == 1).alias("verified"), "text", F.when(F.col("n_chars") > 5000, F.left("text", F.lit(5000))).otherwise(F.col("text")).alias("registry_text"))
    return annotation.record_violations(records, rows.where("toxic = 0").select(unit.alias("unit_id")))


@query(f"""WITH e AS (SELECT q.doc_id AS query_id, d.doc_id AS unit_id, d.source AS source_id, d.lang FROM documents q JOIN documents d ON d.source = q.source AND d.doc_id BETWEEN q.doc_id - 100 AND q.doc_id + 100 WHERE q.doc_id % {QUERY_ROWS} = 0),
p AS (SELECT query_id, CASE lang WHEN 'de' THEN 'ruling' WHEN 'fr' THEN 'facts' ELSE 'unknown' END AS role, CASE WHEN source_id IN ('src1', 'src2', 'src3') THEN ['law', source_id] ELSE [] END AS scope FROM e)
SELECT q.doc_id AS query_id, coalesce(bool_or(role = 'ruling'), false) AS has_decision, coalesce(bool_or(list_has_any(scope, ['law', q.lang])), false) AS scope_matches
FROM documents q LEFT JOIN p ON p.query_id = q.doc_id WHERE q.doc_id % {QUERY_ROWS} = 0 GROUP BY 1""")
def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source near each other as evidence; some languages have a role and some sources a registry entry."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    asked = docs.where(F.col("doc_id") % QUERY_ROWS == 0).select(F.col("doc_id").alias("query_id"), F.col("source").alias("source_id"), F.col("lang").alias("ql"))
    # neighbours by blocks of 100 numbers, so that near ones share a key
    near = asked.select("*", F.explode(F.array(*[F.expr(f"query_id div 100 + {i}") for i in (-1, 0, 1)])).alias("block"))
    found = near.join(docs.select(F.col("doc_id").alias("unit_id"), F.col("source").alias("source_id"), F.expr("doc_id div 100").alias("block"), "lang"), ["source_id", "block"])
    found = found.where("unit_id between query_id - 100 and query_id + 100")
    roles = docs.where("lang in ('de', 'fr')").select(F.col("doc_id").alias("unit_id"), F.when(F.col("lang") == "de", "Ruling").otherwise("facts").alias("role"))
    registry = docs.where("source in ('src1', 'src2', 'src3')").select(F.col("source").alias("source_id"), F.lit("official").alias("authority"), F.array(F.lit("law"), "source").alias("scope")).distinct()
    placed = annotation.evidence_roles(found.select("query_id", "unit_id", "source_id"), roles, registry)
    return annotation.evidence_gates(asked.select("query_id", F.array(F.lit("law"), "ql").alias("terms")), placed)


@query("""WITH o AS (SELECT 'long' AS category, source, doc_id FROM documents WHERE n_chars > 1500 UNION ALL SELECT 'english', source, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'any', source, doc_id FROM documents),
s AS (SELECT *, round((row_number() OVER (PARTITION BY category, source ORDER BY doc_id) - 1) / count(*) OVER (PARTITION BY category, source), 9) AS share FROM o),
a AS (SELECT *, row_number() OVER (ORDER BY share, source, doc_id) AS place FROM s WHERE category = 'long' QUALIFY place <= 40),
b AS (SELECT *, row_number() OVER (ORDER BY share, source, doc_id) AS place FROM s WHERE category = 'english' AND doc_id NOT IN (SELECT doc_id FROM a) QUALIFY place <= 30),
c AS (SELECT *, row_number() OVER (ORDER BY share, source, doc_id) AS place FROM s WHERE category = 'any' AND doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) QUALIFY place <= 50)
SELECT category, source, doc_id, CAST(place AS INT) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def draft_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    kinds = F.array_compact(F.array(F.when(F.col("n_chars") > 1500, "long"), F.when(F.col("lang") == "en", "english"), F.lit("any")))
    return sampling.draft_pool(docs.select(F.explode(kinds).alias("category"), "source", "doc_id"), "category", "source", "doc_id", {"long": 40, "english": 30, "any": 50})
