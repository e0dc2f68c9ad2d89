"""The sliding limit: bursts across slides, pauses, and the stream against the table."""

import datetime as dt
import random

import pytest

SCHEMA = "id long, who string, ts timestamp"
START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def brute(rows, limit, seconds):
    """Every request against all admitted ones of its key."""
    admitted, out = {}, {}
    for i, who, ts in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        if ts is None:
            out[i] = False
            continue
        near = [t for t in admitted.setdefault(who, []) if (ts - t).total_seconds() < seconds]
        out[i] = len(near) < limit
        if out[i]:
            admitted[who].append(ts)
    return out


def some(n, seed, span):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab"), START + dt.timedelta(seconds=rng.choice([rng.random() * span, 100 + rng.random() * 30, 40 + 60 * rng.randint(0, 3)]))) for i in range(n)]
    return [*rows, (n, None, START), (n + 1, None, START), (n + 2, "a", None)]


def test_thirty_in_any_sixty_seconds(spark):
    from tamarisk.streaming.limits import judged

    # 20 at 55 s and 20 at 65 s: no aligned window of 10 or 60 s sees more than 30, a sliding one does
    rows = [(i, "a", START + dt.timedelta(seconds=55 if i < 20 else 65)) for i in range(40)] + [(40, "a", START + dt.timedelta(seconds=115)), (41, "a", START + dt.timedelta(seconds=114.9))]
    got = {r.id: r.admitted for r in judged(spark.createDataFrame(rows, SCHEMA), "who", "id").collect()}
    assert got == brute(rows, 30, 60) and sum(got.values()) == 31 and got[40] and not got[41]


@pytest.mark.parametrize(("limit", "seconds"), [(1, 5), (3, 20), (30, 60)])
def test_against_brute_force(spark, limit, seconds):
    from tamarisk.streaming.limits import judged

    rows = some(600, limit, 2000)
    got = judged(spark.createDataFrame(rows, SCHEMA).repartition(7), "who", "id", limit, seconds).collect()
    assert len(got) == len(rows) and {r.id: r.admitted for r in got} == brute(rows, limit, seconds)
    assert judged(spark.createDataFrame([], SCHEMA), "who", "id").count() == 0
    with pytest.raises(ValueError):
        judged(spark.createDataFrame(rows, SCHEMA), "who", "id", 0)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from tamarisk.streaming.limits import judged_stream

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = sorted((r for r in some(300, 9, 400) if r[2]), key=lambda r: (r[2], r[0]))
        folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "c", "out"))
        for a in (0, 120, 200):
            end = {0: 120, 120: 200, 200: len(rows)}[a]
            spark.createDataFrame(rows[a:end], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            stream = judged_stream(spark.readStream.schema(SCHEMA).parquet(folder), "who", "id", 5, 30)
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        got = spark.read.parquet(out).collect()
        assert len(got) == len(rows) and {r.id: r.admitted for r in got} == brute(rows, 5, 30)
    finally:
        spark.conf.unset(key)
