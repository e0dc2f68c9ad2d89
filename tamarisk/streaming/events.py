"""Streams of events: sliding limits, windowed figures and incremental ranking, each equal to its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which wants time stamps with a zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def rate_counts(events: DataFrame, by: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """``start, by, n`` of sliding windows; on a stream, rows later than ``late`` are left out by the watermark."""
    return timed(events, late).groupBy(F.window("ts", window, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def over_limit(events: DataFrame, by: str, limit: int = 30, **windows: str) -> DataFrame:
    return rate_counts(events, by, **windows).where(F.col("n") > limit)


def window_figures(events: DataFrame, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    out = timed(events, late).groupBy(F.window("ts", window).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that a stream has at present, run to its end and read back from memory: for tests and small backfills."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def resumable_blocks(stream: DataFrame, write_block, checkpoint: str) -> None:
    """Each micro-batch through ``write_block(frame, batch_id)`` once; a restart goes on after the last finished block."""
    stream.writeStream.foreachBatch(write_block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
