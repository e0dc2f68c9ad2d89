"""Pages made of an order's lines: gold regions and blocks that lie near them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import regions
from tamarisk.queries.tables import table
from tamarisk.registry import query


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # one line a number: of repeated ones the least of each column
    # dealt by page once, which serves all grouping behind
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").cast("double").alias("q"), *[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")], F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("t"))
    n = F.col("l_linenumber")
    gold = li.select(F.col("l_orderkey").alias("page"), n.alias("region"), n.alias("place"), F.when(F.col("l_returnflag") == "N", "heading").otherwise("text").alias("kind"), F.col("t").alias("text"),
                     F.col("q").alias("g_x0"), (n * 10.0).alias("g_y0"), (F.col("q") + 20).alias("g_x1"), (n * 10.0 + 8).alias("g_y1"))
    down = n * 10.0 + (F.col("l_partkey") % 3) * 4
    blocks = li.select(F.col("l_orderkey").alias("page"), n.alias("block"), (F.col("l_partkey") % 10).alias("order"), F.when(F.col("l_linestatus") == "O", "heading").otherwise("text").alias("kind"), F.col("t").alias("text"),
                       (F.col("q") + 2).alias("x0"), down.alias("y0"), (F.col("q") + 12).alias("x1"), (down + 6).alias("y1"))
    return gold, blocks


@query("""WITH li AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_quantity)::DOUBLE AS q, min(l_partkey) AS p, min(l_returnflag) = 'N' AS gold_heading, min(l_linestatus) = 'O' AS block_heading, 's' || min(l_suppkey) AS t FROM lineitem GROUP BY 1, 2),
g AS (SELECT page, n AS region, gold_heading, t, q AS gx0, n * 10.0 AS gy0, q + 20 AS gx1, n * 10.0 + 8 AS gy1 FROM li),
b AS (SELECT page, n AS block, p % 10 AS ord, block_heading, t, q + 2 AS x0, n * 10.0 + (p % 3) * 4 AS y0, q + 12 AS x1, n * 10.0 + (p % 3) * 4 + 6 AS y1 FROM li),
a AS (SELECT g.page, g.region, g.gold_heading, b.block, b.ord, b.block_heading, b.t FROM g JOIN b ON g.page = b.page
  WHERE greatest(0, least(x1, gx1) - greatest(x0, gx0)) * greatest(0, least(y1, gy1) - greatest(y0, gy0)) / ((x1 - x0) * (y1 - y0)) >= 0.2 OR ((x0 + x1) / 2 BETWEEN gx0 AND gx1 AND (y0 + y1) / 2 BETWEEN gy0 AND gy1)),
owned AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY region) = 1 AS own FROM a),
texts AS (SELECT g.page, g.region, g.gold_heading, g.t AS reference, coalesce(trim(string_agg(a.t, ' ' ORDER BY a.ord, a.block)), '') AS hypothesis, coalesce(bool_or(a.block_heading), false) AS hit FROM g LEFT JOIN a ON a.page = g.page AND a.region = g.region GROUP BY ALL),
pages AS (SELECT page, count(*) AS regions, count(*) FILTER (gold_heading) AS h, count(*) FILTER (gold_heading AND hit) AS tp, string_agg(reference, ' ' ORDER BY region) AS reference, string_agg(hypothesis, ' ' ORDER BY region) AS hypothesis FROM texts GROUP BY 1),
stray AS (SELECT b.page, count(*) AS fp FROM b LEFT JOIN owned o ON o.page = b.page AND o.block = b.block AND o.own WHERE b.block_heading AND NOT coalesce(o.gold_heading, false) GROUP BY 1),
firsts AS (SELECT page, region, min({'o': ord, 'b': block}) AS at FROM owned WHERE own GROUP BY 1, 2),
pairs AS (SELECT x.page, count(*) AS n, count(*) FILTER (x.at < y.at) AS ok FROM firsts x JOIN firsts y ON x.page = y.page AND x.region < y.region GROUP BY 1),
r AS (SELECT page, regions, CASE WHEN tp + coalesce(fp, 0) > 0 THEN round(tp / (tp + coalesce(fp, 0)), 8) WHEN h = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN h > 0 THEN round(tp / h, 8) ELSE 1.0 END AS c, coalesce(round(ok / n, 8), 1.0) AS order_accuracy, reference, hypothesis
  FROM pages LEFT JOIN stray USING (page) LEFT JOIN pairs USING (page))
SELECT page, regions, p::DOUBLE AS heading_precision, c::DOUBLE AS heading_recall, CASE WHEN p + c > 0 THEN round(2 * p * c / (p + c), 8)::DOUBLE ELSE 0.0::DOUBLE END AS heading_f1, order_accuracy::DOUBLE AS order_accuracy, reference, hypothesis FROM r""")
def anchored_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.anchored_measures(*_pages(spark, sf_dir))
    return rows.select("page", "regions", "heading_precision", "heading_recall", "heading_f1", "order_accuracy", "reference", "hypothesis")


@query()
def reading_order_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's words in gold order and as parsed: how alike they are; tests hold the operator against plain versions."""
    rows = regions.anchored_measures(*_pages(spark, sf_dir))
    return rows.select("page", F.round(regions.order_ratio(F.col("reference"), F.col("hypothesis")), 8).alias("ratio"))
