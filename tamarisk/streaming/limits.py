"""An exact sliding limit on requests: at most so many admitted ones in any stretch of time of the window's length.

Requests of a key are judged in order of time and identifier; one is admitted if fewer than ``limit`` were admitted less than a window before it, and only admitted ones
count. What is kept of a key are the times of those at most. On a stream that is keyed state with a timer that clears it when a window has passed without
a request. A table gives the same decisions: a pause of a window or more forgets all before it, so the stretches between pauses are judged
apart from each other, each as a stream of rows in its task. Pauses are found by ranges of key and time, so a key of any size spans tasks
as far as it pauses.

Rows without a time are refused; a null key is a key. Clocks don't go back: on a stream a request that comes after a later one of its key was admitted is judged at that
one's time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tamarisk.plans.lineage import cut


class Sliding:
    """The times of what was admitted within the last window, in microseconds."""

    def __init__(self, limit: int, window: int, held: Iterable[int] = ()) -> None:
        self.limit, self.window, self.held = limit, window, deque(held)

    def admits(self, at: int | None) -> bool:
        if at is None:
            return False
        now = max(at, self.held[-1]) if self.held else at
        while self.held and now - self.held[0] >= self.window:
            self.held.popleft()
        if len(self.held) >= self.limit:
            return False
        self.held.append(now)
        return True


def _checked(limit: int, seconds: float) -> int:
    if limit < 1 or seconds <= 0:
        raise ValueError("a limit admits at least one request, and a window lasts some time")
    return round(seconds * 1_000_000)


def _micros() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def stretches(requests: DataFrame, by: str, key: str, micros: int) -> DataFrame:
    """``_by, _at, _id`` of the requests and ``_stretch``, which grows by one with each pause of a window of its key."""
    rows = requests.select(F.col(by).alias("_by"), _micros().alias("_at"), F.col(key).alias("_id"))
    dealt = cut(rows.repartitionByRange("_by", "_at", "_id").withColumn("_range", F.spark_partition_id()))
    of = Window.partitionBy("_by")
    ends = dealt.groupBy("_by", "_range").agg(F.max("_at").alias("_last"))
    ends = ends.select(F.col("_by").alias("_b"), F.col("_range").alias("_r"), F.max("_last").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = dealt.join(ends, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r"))).drop("_b", "_r")
    within = Window.partitionBy("_by", "_range").orderBy("_at", "_id")
    previous = F.coalesce(F.lag("_at").over(within), F.col("_before"))
    rows = rows.withColumn("_pause", F.coalesce((F.col("_at") - previous >= micros).cast("long"), F.lit(0)))
    rows = rows.withColumn("_own", F.sum("_pause").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = rows.groupBy("_by", "_range").agg(F.sum("_pause").alias("_sum"))
    sums = sums.select(F.col("_by").alias("_b"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(sums, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")))
    return rows.select("_by", "_at", "_id", (F.col("_base") + F.col("_own")).alias("_stretch"))


def judged(requests: DataFrame, by: str, key: str, limit: int = 30, seconds: float = 60.0) -> DataFrame:
    """``by, key, admitted`` of every row of a table of requests with a time ``ts``."""
    micros = _checked(limit, seconds)
    rows = stretches(requests, by, key, micros)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sliding = None, Sliding(limit, micros)
        for batch in batches:
            out = []
            for at, *stretch in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if stretch != now:
                    now, sliding = stretch, Sliding(limit, micros)
                out.append(sliding.admits(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], [by, key, "admitted"])

    schema = StructType([StructField(by, requests.schema[by].dataType), StructField(key, requests.schema[key].dataType), StructField("admitted", BooleanType())])
    return rows.repartition("_by", "_stretch").sortWithinPartitions("_by", "_stretch", "_at", "_id").mapInArrow(run, schema)


class _Limiter(StatefulProcessor):
    """A key's admitted times as a list in Spark's state, cleared by a timer."""

    def __init__(self, limit: int, micros: int) -> None:
        self.limit, self.micros = limit, micros

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getListState("admitted", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        from pyspark.sql import Row

        sliding = Sliding(self.limit, self.micros, (r[0] for r in self.times.get()))
        for r in sorted(rows, key=lambda r: (r["_at"] is not None, r["_at"] or 0, r["_id"] is not None, r["_id"])):
            yield Row(_by=key[0], _id=r["_id"], admitted=sliding.admits(r["_at"]))
        self.times.put([(at,) for at in sliding.held])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if sliding.held:
            self.handle.registerTimer(max(sliding.held[-1] // 1000 + self.micros // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged_stream(requests: DataFrame, by: str, key: str, limit: int = 30, seconds: float = 60.0, late: str = "1 hour") -> DataFrame:
    """The same of a stream; rows later than ``late`` are left out by the watermark. The session's state store must be the one that keeps timers (RocksDB)."""
    micros = _checked(limit, seconds)
    rows = requests.select(F.col(by).alias("_by"), F.col(key).alias("_id"), F.col("ts").cast("timestamp").alias("ts"), _micros().alias("_at")).withWatermark("ts", late)
    schema = StructType([StructField("_by", requests.schema[by].dataType), StructField("_id", requests.schema[key].dataType), StructField("admitted", BooleanType())])
    out = rows.groupBy("_by").transformWithState(_Limiter(limit, micros), schema, "Append", "EventTime")
    return out.select(F.col("_by").alias(by), F.col("_id").alias(key), "admitted")
