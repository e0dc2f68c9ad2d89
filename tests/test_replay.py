"""Replays of stored responses: the last valid attempt counts, and replaying again changes nothing."""

import json


def answer(*texts):
    return json.dumps({"regulated_entities": [{"text": t} for t in texts]})


def told(frame):
    return {(r.record_id, r.status, r.attempt) for r in frame.collect()}


def test_last_valid_attempt(spark):
    from tamarisk.operators.replay import outcomes, replayed

    rows = [(1, 1, answer("a")), (1, 2, answer("b")), (1, 3, "broken"), (2, 1, "{"), (2, 2, None), (3, 1, None), (4, 2, answer("gone")), (4, 1, answer("text")), (5, 1, answer())]
    log = spark.createDataFrame(rows, "record_id long, attempt int, raw string")
    assert told(outcomes(log)) == {(1, "completed", 2), (2, "failed", None), (3, "pending", None), (4, "completed", 2), (5, "completed", 1)}
    units = spark.createDataFrame([(i, "a text with b") for i in range(1, 6)], "item_id long, text string")
    known = spark.createDataFrame([(i, "T001", "temporal") for i in range(1, 6)], "item_id long, label string, kind string")
    got = replayed(log, units, known)
    assert {(r.item_id, r.text) for r in got["quotes"].collect()} == {(1, "b")}
    assert {(r.record_id, r.dropped, r.corrected, r.empty) for r in got["statuses"].collect()} == {(1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False), (4, 1, 0, True), (5, 0, 0, True)}
    assert outcomes(log.limit(0)).count() == 0


def test_batches_that_come_again(spark, tmp_path):
    from tamarisk.operators.replay import log, logged, outcomes

    path, folder, checkpoint = (str(tmp_path / x) for x in ("log", "in", "c"))
    schema = "record_id long, attempt int, raw string"
    write = logged(path)
    first = spark.createDataFrame([(1, 1, answer("a")), (2, 1, None)], schema)
    write(first, 0)
    write(first, 0)
    assert log(spark, path).count() == 2 and told(outcomes(log(spark, path))) == {(1, "completed", 1), (2, "pending", None)}
    write(spark.createDataFrame([(2, 1, "broken"), (1, 2, None)], schema), 1)
    want = {(1, "completed", 1), (2, "failed", None)}
    assert told(outcomes(log(spark, path))) == want and told(outcomes(log(spark, path))) == want
    for part in ([(3, 1, answer("x"))], [(3, 2, "no"), (4, 1, answer())]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):  # the second finds nothing new
            stream = spark.readStream.schema(schema).parquet(folder)
            stream.writeStream.foreachBatch(logged(f"{path}-s")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert told(outcomes(log(spark, f"{path}-s"))) == {(3, "completed", 1), (4, "completed", 1)}
