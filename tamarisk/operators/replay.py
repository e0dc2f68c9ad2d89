"""Stored responses of an extractor replayed without asking it again: the last valid attempt of each record counts.

The log has a row an attempt (``record_id, attempt, raw``; ``raw`` is null where nothing came back). It grows by batches, and each batch is a folder of its own that is written whole: a batch that comes again
replaces itself, so replaying a stream any number of times gives one log. The same attempt in several batches is one, as the latest of them says. A record is ``completed`` by its last attempt whose answer is a
proposal, ``failed`` where answers came and none is one, and ``pending`` where none came; an attempt after a valid one that failed takes nothing back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.proposals import assembled, parsed

LOG = "record_id long, attempt int, raw string, batch long"


def logged(path: str):
    """A function for ``foreachBatch`` that writes attempts to the log at ``path``, each batch once however often it comes."""

    def write(frame: DataFrame, batch: int) -> None:
        rows = frame.select(F.col("record_id").cast("long").alias("record_id"), F.col("attempt").cast("int").alias("attempt"), "raw")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("basePath", path).parquet(f"{path}/batch=*")


def outcomes(attempts: DataFrame) -> DataFrame:
    """``record_id, status, attempt, raw, attempts`` of every record: the attempt that counts, if any."""
    order = F.col("batch") if "batch" in attempts.columns else F.lit(0)
    latest = attempts.groupBy("record_id", "attempt").agg(F.max_by("raw", F.struct(order, F.col("raw").isNotNull(), "raw")).alias("raw"))
    keyed = latest.select(F.struct("record_id", "attempt").alias("item_id"), "raw")
    valid = parsed(keyed).where("p is not null").select("item_id.*", F.lit(True).alias("valid"))
    rows = latest.join(valid, ["record_id", "attempt"], "left")
    best = F.max(F.when(F.col("valid"), F.struct("attempt", "raw")))
    folded = rows.groupBy("record_id").agg(best.alias("b"), F.count_if(F.col("raw").isNotNull()).alias("answers"), F.count("*").alias("attempts"))
    status = F.when(F.col("b").isNotNull(), "completed").when(F.col("answers") > 0, "failed").otherwise("pending")
    return folded.select("record_id", status.alias("status"), F.col("b.attempt").alias("attempt"), F.col("b.raw").alias("raw"), "attempts")


def replayed(attempts: DataFrame, units: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """``proposals.assembled`` of the attempts that count, and ``statuses`` (``record_id, status, attempt, dropped, corrected, empty``)."""
    done = outcomes(attempts)
    got = assembled(units, candidates, done.where("status = 'completed'").select(F.col("record_id").alias("item_id"), "raw"))
    notes = got["diagnostics"].groupBy("item_id").agg(F.count_if(~F.col("accepted")).alias("dropped"), F.count_if(F.col("accepted")).alias("corrected"))
    kept = got["quotes"].select("item_id").unionByName(got["references"].select("item_id")).distinct().withColumn("_some", F.lit(True))
    rows = done.join(notes.withColumnRenamed("item_id", "record_id"), "record_id", "left").join(kept.withColumnRenamed("item_id", "record_id"), "record_id", "left")
    statuses = rows.select("record_id", "status", "attempt", F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("corrected", F.lit(0)).alias("corrected"),
                           ((F.col("status") == "completed") & F.col("_some").isNull()).alias("empty"))
    return {**got, "statuses": statuses}
