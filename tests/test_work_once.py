"""Steps that are dear a row run once, on all cores, and not where a plain look rules a row out."""

from pyspark.sql import functions as F


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_made_once(spark, small):
    from tamarisk.queries.structure import chunk_summary

    assert "EvalPython" not in plan(chunk_summary(spark, small))


def test_values_are_found_on_all_cores(spark, small):
    from tamarisk.queries.identity_build import extract_values

    assert extract_values(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_patterns_of_addresses_need_their_sign(spark):
    from tamarisk.operators.quality import privacy_findings, redacted

    d = spark.createDataFrame([(1, "a.b@c.de x"), (2, "none"), (3, None), (4, "@ alone")], "k int, t string")
    found = privacy_findings(d, "k", ["t"])
    assert ", @)" in plan(found) and [r.k for r in found.collect()] == [1]
    assert [r.t for r in d.select(redacted(F.col("t")).alias("t")).collect()] == ["[REDACTED] x", "none", None, "@ alone"]


def test_labels_of_a_batch_are_parsed_once(spark):
    import inspect

    from tamarisk.operators import labels

    d = spark.createDataFrame([(i, (None, "المادة 3", "المادة 4", "x")[i % 4]) for i in range(40)], "i int, t string")
    got = {(r.i % 4, r.n) for r in d.select("i", labels.parsed_label(F.col("t"))["ordinal"].alias("n")).collect()}
    assert got == {(0, None), (1, 3), (2, 4), (3, None)}
    assert "dictionary_encode" in inspect.getsource(labels.parsed_label)
