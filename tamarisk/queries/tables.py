"""The driver's tables in the roles that the operators know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import lexical, postings
from tamarisk.plans.lineage import written
from tamarisk.sources.stores import exists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a scan has fewer parts than there are cores, as of a file with one row group.

    Larger tables have more parts and are left as they are.
    """
    n = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= n else frame.repartition(n)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


_indexes: dict[tuple[str, str], tuple[str, postings.Index]] = {}


def corpus_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The lexical index of a folder's documents: built by the first query of a session that asks, and again when their files have changed or the index is gone."""
    key, now = (spark.sparkContext.applicationId, sf_dir), written(f"{sf_dir}/documents.parquet", spark)
    if key not in _indexes or _indexes[key][0] != now or not exists(spark, f"{_indexes[key][1].path}/figures"):
        _indexes[key] = (now, lexical.indexed(corpus(spark, sf_dir)))
    return _indexes[key][1]


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


#: The stated query set of searches: every row whose id is divisible by 50, against all rows.
QUERY_ROWS = 50
