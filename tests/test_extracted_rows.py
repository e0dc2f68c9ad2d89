"""Results of extraction stay in their documents' rows."""

from pyspark.sql import functions as F


def test_extraction_joins_and_shuffles_nothing(spark):
    from tamarisk.operators.extraction import candidates, extracted

    texts = ["المادة (7) تنص على المادة (7) خلال ٣٠ يوماً في 1/2/1440هـ", None, "", "نظام العمل و المادة 3"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plan = extracted(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = {r.doc_id: r for r in extracted(docs).collect()}
    assert set(rows) == {None, 1, 2, 3} and rows[1].candidates is None and rows[2].candidates is None and rows[1].articles == []
    flat = {(r.doc_id, c.label, c.type, c.start, c.end, c.raw, c.value, c.status, c.calendar) for r in rows.values() for c in r.candidates or []}
    assert flat == {tuple(r) for r in candidates(docs).select("doc_id", "label", "type", "start", "end", "raw", "value", "status", "calendar").collect()}
    assert rows[None].articles == ["A001", "A002"] and rows[3].regulations == ["R001"]
    assert [c.start for c in rows[None].candidates] == sorted(c.start for c in rows[None].candidates)
    assert extracted(docs.where(F.col("doc_id") == 1)).count() == 1
