"""Measures and searches that don't list pairs of queries and documents give what the listing ones give."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def judgements(spark):
    rng = np.random.default_rng(4)
    members = spark.createDataFrame([(int(d % 4), d, int(rng.integers(0, 4))) for d in range(60)] + [(0, 0, 3), (5, 900, 0)], "group long, doc_id long, grade int")
    asked = spark.createDataFrame([(q, q % 6) for q in range(12)] + [(99, None)], "query_id long, group long")
    ranked = spark.createDataFrame([(q, int(d), r + 1) for q in range(12) for r, d in enumerate(rng.permutation(60)[:12])], "query_id long, doc_id long, rank int")
    return ranked, asked, members


def test_measures_by_group(judgements):
    from tamarisk.operators import metrics

    ranked, asked, members = judgements
    got = metrics.measures(metrics.judged_by_group(ranked, asked, members, 10), 10)
    wanted = metrics.query_metrics(ranked, asked.join(members, "group").select("query_id", "doc_id", "grade"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 6


def test_complete_by_group(judgements):
    from tamarisk.operators import metrics

    ranked, asked, members = judgements
    parts = members.selectExpr("group", "doc_id % 2 as group_id", "doc_id")
    got = metrics.complete_by_group(ranked, asked, parts, 10).collect()
    wanted = metrics.complete_evidence(ranked, asked.join(parts, "group").select("query_id", "group_id", "doc_id"), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and {r.complete for r in got} == {0, 1}


def test_each_task_keeps_the_best_and_plain_products_agree(spark, monkeypatch):
    from tamarisk.operators import dense

    monkeypatch.setattr(dense, "HELD", 50)
    monkeypatch.setattr(dense, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, x[3].tolist()), (901, None)], "id long, vector array<double>").repartition(3)
    q = v.where("id % 10 = 0")
    every = spark.createDataFrame([(a, b, float(s)) for a in range(5) for b, s in enumerate(np.round(x[a] @ x.T, 10))], "query_id long, doc_id long, score double").coalesce(2)
    assert dense._kept(every, 4).count() <= 2 * 5 * 4
    got = sorted(map(tuple, dense.plain_top_k(v, q, 6).collect()))
    found = sorted(map(tuple, dense.dense_top_k(v, q, 6).collect()))
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in found] and len(got) == 6 * 31
    assert max(abs(a[2] - b[2]) for a, b in zip(got, found)) < 1e-9
