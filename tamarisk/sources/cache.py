"""Results kept by the content they came from: an item is worked out again exactly when one of its inputs, or the run's settings, have changed.

An item's digest is made of all its input rows in every input table and of the run. Rows are added up as hashes, so their order doesn't matter, an input of any size merges over
tasks, and a missing or repeated row shows. A store has ``results`` and, written after them, ``done``: for each item worked out its digest, the batch, how many rows it gave and their digest.
Only rows of a batch that ``done`` names count, so a job that fails between the two leaves nothing that is read; an item without rows is done all the same; and where
stored rows no longer add up to their digest, the item is worked out anew. Neither table has a text beyond what ``step`` returns.

A null key is an item like any other; an item that appears several times is one. Keys have an order; inputs may have any columns that can be hashed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.identity import fingerprint
from tamarisk.plans.lineage import cut
from tamarisk.sources.stores import exists


def _summed(columns: list[str]) -> Column:
    """A digest of rows as a set with repetition: their number, a sum and an exclusive or of two hashes."""
    one, other = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string"), F.bit_xor(other).cast("string"))


def input_digests(items: DataFrame, key: str, inputs: Mapping[str, DataFrame], run: dict[str, Any]) -> DataFrame:
    """``key, digest`` of every item; each input has the key among its columns."""
    rows = items.select(F.col(key).alias("_k")).distinct()
    for name, frame in sorted(inputs.items()):
        own = sorted(c for c in frame.columns if c != key)
        part = frame.groupBy(F.col(key).alias("_o")).agg(_summed(own).alias(f"_d_{name}"))
        rows = rows.join(part, F.col("_k").eqNullSafe(F.col("_o")), "left").drop("_o")
    parts = [F.coalesce(f"_d_{name}", F.lit("none")) for name in sorted(inputs)]
    return rows.select(F.col("_k").alias(key), F.sha2(F.concat_ws("|", F.lit(fingerprint(run)), *parts), 256).alias("digest"))


def _good(items: DataFrame, key: str, path: str) -> DataFrame:
    """``key, digest, batch`` of what is stored and adds up, the latest batch of each."""
    spark = items.sparkSession
    done = spark.read.parquet(f"{path}/done").select(F.col(key).alias("_k"), "digest", "batch", "at", "rows", "sum")
    if exists(spark, f"{path}/results"):
        stored = spark.read.parquet(f"{path}/results")
        own = sorted(c for c in stored.columns if c not in ("digest", "batch"))
        sums = stored.groupBy(F.col(key).alias("_o"), F.col("digest").alias("_e"), F.col("batch").alias("_b")).agg(_summed(own).alias("now"))
        done = done.join(sums, F.col("_k").eqNullSafe(F.col("_o")) & (F.col("digest") == F.col("_e")) & (F.col("batch") == F.col("_b")), "left")
    else:
        done = done.withColumn("now", F.lit(None).cast("string"))
    right = F.when(F.col("rows") == 0, F.col("now").isNull()).otherwise(F.coalesce(F.col("now") == F.col("sum"), F.lit(False)))
    latest = done.where(right).groupBy("_k", "digest").agg(F.max(F.struct("at", "batch")).alias("m"))
    return latest.select("_k", F.col("digest").alias("_g"), F.col("m.batch").alias("_batch"))


def cached(items: DataFrame, key: str, inputs: Mapping[str, DataFrame], path: str, run: dict[str, Any], step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The results of ``step(items)`` for all items (its columns, the key among them), and ``key, rebuilt``: whether an item was worked out now."""
    spark = items.sparkSession
    wanted = cut(input_digests(items, key, inputs, run))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_g"))
    if exists(spark, f"{path}/done"):
        left = cut(wanted.join(_good(items, key, path), same, "left_anti"))
    else:
        left = wanted
    if not left.isEmpty():
        batch = uuid.uuid4().hex
        at = spark.read.parquet(f"{path}/done").agg(F.max("at")).first()[0] + 1 if exists(spark, f"{path}/done") else 1
        chosen = left.select(F.col(key).alias("_k"), F.col("digest").alias("_w"))
        made = step(items.join(chosen, F.col(key).eqNullSafe(F.col("_k")), "left_semi"))
        made.join(chosen, F.col(key).eqNullSafe(F.col("_k"))).drop("_k").withColumnRenamed("_w", "digest").withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/results")
        stored = spark.read.parquet(f"{path}/results").where(F.col("batch") == batch)
        own = sorted(c for c in stored.columns if c not in ("digest", "batch"))
        sums = stored.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("rows"), _summed(own).alias("sum"))
        rows = left.join(sums, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
        rows.select(key, "digest", F.lit(batch).alias("batch"), F.lit(at).alias("at"), F.coalesce("rows", F.lit(0)).alias("rows"), "sum").write.mode("append").parquet(f"{path}/done")
    valid = _good(items, key, path)
    current = wanted.join(valid, same).select(F.col(key).alias("_k"), F.col("digest").alias("_g"), "_batch")
    results = spark.read.parquet(f"{path}/results")
    kept = results.join(current, F.col(key).eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_g")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("digest", "batch")
    marked = wanted.select(key).join(left.select(F.col(key).alias("_k"), F.lit(True).alias("_now")), F.col(key).eqNullSafe(F.col("_k")), "left")
    return kept, marked.select(key, F.coalesce("_now", F.lit(False)).alias("rebuilt"))
