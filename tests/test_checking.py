"""Reconciliation, annotation rules and evidence roles on literal rows."""

import pytest
from pyspark.sql import functions as F


def test_every_kind_of_difference(spark):
    from tamarisk.operators.reconcile import differences, verdict

    schema = "k long, g string, x double, n long, s string, only long"
    nan = float("nan")
    left = spark.createDataFrame([(1, "a", 1.0, 5, "s", 1), (2, "a", nan, 5, None, 1), (3, "a", 1.0, 5, "s", 1), (4, None, 1.0, 5, "s", 1), (5, "a", 1.0, 5, "s", 1), (5, "a", 2.0, 5, "s", 1), (6, "a", nan, 5, "s", 1), (8, "a", None, None, None, 1)], schema)
    right = spark.createDataFrame([(1, "a", 1.0 + 1e-13, 7, "s", "1"), (2, "a", nan, 5, "now", "1"), (4, None, 1.1, 5, "t", "1"), (5, "a", 9.0, 9, "z", "1"), (6, "a", 1.0, 8, None, "1"), (7, "a", 1.0, 5, "s", "1"), (7, "a", 1.0, 5, "s", "1"), (8, "a", None, None, None, "1")],
                                  schema.replace("only long", "only string"))
    got = {(r.k, r.kind, r.column) for r in differences(left, right, ["k", "g"], {"x": 1e-12, "n": 2}).collect()}
    assert got == {
        (2, "value_missing_left", "s"), (3, "only_left", None), (4, "value_differs", "x"), (4, "value_differs", "s"), (5, "repeated_left", None), (6, "value_differs", "x"),
        (6, "value_differs", "n"), (6, "value_missing_right", "s"), (7, "only_right", None), (7, "repeated_right", None),
    }
    told = verdict(left, right, ["k", "g"], {"x": 1e-12, "n": 2})
    assert told["counts"]["value_differs"] == 4 and told["schema"] == [("only", "bigint", "string")] and not told["agrees"]
    with pytest.raises(ValueError):
        differences(left, right, ["only"])


def test_gates_by_content(spark):
    from tamarisk.operators.reconcile import content_digest, verdict

    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    digest = rows.agg(content_digest(rows).alias("d")).first().d
    assert rows.orderBy(F.desc("k")).repartition(3).agg(content_digest(rows).alias("d")).first().d == digest
    assert rows.distinct().agg(content_digest(rows).alias("d")).first().d != digest
    one = rows.distinct()
    assert verdict(one, one, ["k"], digests={"left": "other"})["gates"] == {"left": False} and not verdict(one, one, ["k"], digests={"left": "other"})["agrees"]
    assert verdict(one, one, ["k"])["agrees"] and verdict(rows.limit(0), rows.limit(0), ["k"])["agrees"]


def test_annotation_rules(spark):
    from tamarisk.operators.annotation import record_violations, span_violations

    records = spark.createDataFrame([
        (1, "u1", "reviewed", "person", True, "some text", "some text"), (2, "u9", "odd", "dual_ai_agreed", True, "t", "T"), (3, "u1", "in_review", None, False, "t", "t"), (4, None, None, None, None, None, None),
        (5, "u1", "dual_ai_agreed", "person", True, "t", None),
    ], "record_id long, unit_id string, status string, origin string, verified boolean, text string, registry_text string")
    selection = spark.createDataFrame([("u1",), ("u1",)], "unit_id string")
    assert {(r.record_id, r.violation) for r in record_violations(records, selection).collect()} == {
        (2, "unit_not_selected"), (2, "invalid_status"), (2, "machine_review_verified"), (2, "verified_not_reviewed"), (2, "registry_text_differs"),
        (4, "unit_not_selected"), (4, "invalid_status"), (5, "verified_not_reviewed"), (5, "registry_text_differs"),
    }
    spans = [(1, "entity", 0, "some", 0, 4), (1, "entity", 1, "some", 0, 4), (1, "penalty", 0, "some", 0, 4), (1, "entity", 2, "text", 4, 8), (1, "entity", 3, "", 2, 2), (1, "entity", 4, "text", 5, 9), (9, "entity", 0, "x", 0, 1), (1, "entity", 5, "t", None, 1)]
    got = span_violations(spark.createDataFrame(spans, "record_id long, kind string, place int, text string, start int, end int"), records).collect()
    assert {(r.record_id, r.kind, r.violation, r.place) for r in got} == {
        (1, "entity", "duplicate_span", 1), (1, "entity", "span_not_exact", 2), (1, "entity", "span_not_exact", 3), (9, "entity", "span_not_exact", 0), (1, "entity", "span_not_exact", 5),
    }


def test_roles_and_gates(spark):
    from tamarisk.operators.annotation import evidence_gates, evidence_roles

    evidence = spark.createDataFrame([(1, "u1", "s1"), (1, "u2", "s2"), (2, "u3", None)], "query_id long, unit_id string, source_id string")
    roles = spark.createDataFrame([("u1", "HOLDING"), ("u3", "facts")], "unit_id string, role string")
    registry = spark.createDataFrame([("s1", "official", ["labor", "court"])], "source_id string, authority string, scope array<string>")
    placed = evidence_roles(evidence, roles, registry)
    assert {(r.unit_id, r.role, r.authority, tuple(r.scope), r.decides) for r in placed.collect()} == {("u1", "holding", "official", ("labor", "court"), True), ("u2", "unknown", "unknown", (), False), ("u3", "facts", "unknown", (), False)}
    asked = spark.createDataFrame([(1, ["court"]), (2, ["court"]), (3, None)], "query_id long, terms array<string>")
    assert {(r.query_id, r.has_decision, r.scope_matches) for r in evidence_gates(asked, placed).collect()} == {(1, True, True), (2, False, False), (3, False, False)}
