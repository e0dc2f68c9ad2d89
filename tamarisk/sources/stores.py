"""Stores that can be taken up again: vectors by fingerprint, results by query, reports and views."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.operators.identity import canonical, fingerprint, without_text


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, payload: Any, path: str) -> None:
    """A small JSON file with sorted keys, written beside and then renamed, on any file system that Spark knows."""
    fs, p = _path(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} can't be written")


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def write_report(spark: SparkSession, payload: Any, path: str) -> str:
    """A report without any text of the corpus; its fingerprint."""
    write_json(spark, without_text(payload), path)
    return fingerprint(payload)


def missing_vectors(texts: DataFrame, path: str, run: dict[str, Any]) -> DataFrame:
    """The rows of ``id, text`` whose vector under this run's configuration (or for this very text) isn't stored yet."""
    spark, f = texts.sparkSession, fingerprint(run)
    if not exists(spark, path):
        return texts
    done = spark.read.parquet(path).where(F.col("run") == f).select("id", F.col("text_hash").alias("h"))
    return texts.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256)).join(done, ["id", "h"], "left_anti").drop("h")


def encode_missing(texts: DataFrame, path: str, run: dict[str, Any], encoder, dimension: int) -> DataFrame:
    """All vectors of this run, after those that were missing were encoded and appended: a job that stopped goes on where it was.

    Each vector is stored beside its run's fingerprint and its text's digest, so no stale one is ever read.
    """
    from tamarisk.operators.dense import encoded

    spark, f = texts.sparkSession, fingerprint(run)
    left = missing_vectors(texts, path, run)
    made = encoded(left, encoder, dimension).join(left.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")), "id")
    made.select("id", "vector", "text_hash", F.lit(f).alias("run")).write.mode("append").partitionBy("run").parquet(path)
    now = texts.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return spark.read.parquet(path).where(F.col("run") == f).join(now, ["id", "text_hash"], "left_semi").dropDuplicates(["id"]).select("id", "vector")


def store_status(texts: DataFrame, path: str, run: dict[str, Any], dimension: int) -> DataFrame:
    """One row: rows wanted, stored and missing, stale rows (another text's), and vectors that are faulty."""
    spark, f = texts.sparkSession, fingerprint(run)
    want = texts.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want"))
    if not exists(spark, path):
        return want.agg(F.count("*").alias("wanted"), F.lit(0).cast("long").alias("stored"), F.count("*").alias("missing"), F.lit(0).cast("long").alias("stale"), F.lit(0).cast("long").alias("faulty"))
    have = spark.read.parquet(path).where(F.col("run") == f)
    odd = (F.size("vector") != dimension) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    both = want.join(have, "id", "full_outer")
    fresh = F.coalesce(F.col("want") == F.col("text_hash"), F.lit(False))
    return both.agg(
        F.count_distinct(F.when(F.col("want").isNotNull(), F.col("id"))).alias("wanted"), F.count_distinct(F.when(fresh, F.col("id"))).alias("stored"),
        (F.count_distinct(F.when(F.col("want").isNotNull(), F.col("id"))) - F.count_distinct(F.when(fresh, F.col("id")))).alias("missing"),
        F.count_if(~fresh & F.col("text_hash").isNotNull()).alias("stale"), F.count_if(fresh & odd).alias("faulty"),
    )


def resumed(items: DataFrame, key: str, path: str, run: dict[str, Any], step) -> DataFrame:
    """Results of ``step(frame)`` for all items, of which those stored under this run's fingerprint aren't worked out again."""
    spark, f = items.sparkSession, fingerprint(run)
    left = items
    if exists(spark, path):
        left = items.join(spark.read.parquet(path).where(F.col("run") == f).select(key).distinct(), key, "left_anti")
    step(left).withColumn("run", F.lit(f)).write.mode("append").partitionBy("run").parquet(path)
    return spark.read.parquet(path).where(F.col("run") == f).drop("run")


def once(spark: SparkSession, path: str, run: dict[str, Any], evaluate) -> Any:
    """What ``evaluate()`` gives, worked out once for a run: the ledger's entry counts from then on, and another run is refused."""
    f = fingerprint(run)
    if exists(spark, path):
        entry = read_json(spark, path)
        if entry["run"] != f:
            raise ValueError("the holdout was already evaluated by another run")
        return entry["result"]
    result = evaluate()
    write_json(spark, {"run": f, "result": json.loads(canonical(result))}, path)
    return result


def normalised_views(units: DataFrame, key: str, column: str, path: str, policies: tuple[str, ...] = T.POLICIES) -> DataFrame:
    """The units under every normal form, written by policy; the source's digest tells which text each came from."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy_id"), T.normalised(F.col(column), p).alias("search_text")) for p in policies])).alias("v")
    rows = units.select(key, F.sha2(column, 256).alias("source_hash"), each).select(key, "source_hash", "v.*")
    rows.write.mode("overwrite").partitionBy("policy_id").parquet(path)
    return units.sparkSession.read.parquet(path)


def result_table(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """``name, path, value, digest``: numbers of a JSON file by their paths (``$.a.b``); a path without a number is an error."""
    text = F.concat_ws("\n", F.collect_list("value"))
    whole = spark.read.text(path, wholetext=True).agg(text.alias("t"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("path"), F.get_json_object("t", p).cast("double").alias("value")) for n, p in wanted.items()])
    rows = whole.select(F.sha2("t", 256).alias("digest"), F.explode(each).alias("r")).select("r.*", "digest")
    checked = F.when(F.col("value").isNull() | F.isnan("value"), F.raise_error(F.concat(F.lit("no number at "), F.col("path")))).otherwise(F.col("value"))
    return rows.withColumn("value", checked)
