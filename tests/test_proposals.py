"""Proposals against their sources: every reason, on literal cases and against a plain version."""

import json
import random

import pytest

TEXT = "يجب على المنشأة التسجيل خلال ٣٠ يوماً، ولا يجوز التأخير، ويجوز التمديد وفق المادة (7)."
TWICE = "may renew. may renew again. renew"


@pytest.fixture(scope="module")
def run(spark):
    from tamarisk.operators.proposals import assembled

    def go(text, proposal, known=(("T001", "temporal"), ("M001", "monetary"), ("P001", "percentage"))):
        raw = proposal if isinstance(proposal, str) or proposal is None else json.dumps(proposal, ensure_ascii=False)
        got = assembled(
            spark.createDataFrame([(1, text)], "item_id long, text string"), spark.createDataFrame([(1, a, b) for a, b in known], "item_id long, label string, kind string"),
            spark.createDataFrame([(1, raw)], "item_id long, raw string"),
        )
        return {k: v.collect() for k, v in got.items()}

    return go


def codes(got):
    return sorted((r.field, r.code, r.accepted) for r in got["diagnostics"])


def test_modalities_and_references(run):
    got = run(TEXT, {
        "schema_version": "1", "regulated_entities": [{"text": "المنشأة"}], "deadline_refs": ["T001"],
        "rules": [
            {"modality": "permission", "action": {"text": "التمديد"}}, {"modality": "Prohibition", "action": {"text": "التأخير"}},
            {"modality": "obligation", "actor": {"text": "المنشأة"}, "action": {"text": "التسجيل"}, "deadline_refs": ["T001"]}, {"modality": "other", "action": {"text": "خلال"}},
        ],
    })
    assert [(r.modality, r.rule) for r in sorted(got["rules"], key=lambda r: r.position)] == [("obligation", 2), ("prohibition", 1), ("permission", 0)]
    assert not got["diagnostics"] and {(r.field, r.label) for r in got["references"]} == {("deadline_refs", "T001"), ("rules[2].deadline_refs", "T001")}
    assert all(TEXT[r.start : r.end] == r.text for r in got["quotes"]) and len(got["quotes"]) == 6


def test_what_is_not_in_the_text_is_dropped(run):
    got = run(TWICE, {
        "regulated_entities": [{"text": "nowhere"}, {"text": ""}], "penalties": [{"text": "fine"}],
        "rules": [
            {"modality": "permission", "action": {"text": "again", "occurrence": 7}, "actor": {"text": "nobody"}, "conditions": [{"text": "may", "occurrence": 1}, {"text": "may"}],
             "monetary_threshold_refs": ["M001", "P001"], "percentage_threshold_refs": ["P001", "T999"]},
            {"modality": "permission", "action": {"text": "renew"}, "actor": {"text": "nobody else"}, "deadline_refs": ["X"]}, {"modality": "permission", "action": {"text": "renew", "occurrence": 2}},
            {"modality": "permission", "action": {"text": "renew", "occurrence": 3}},
        ],
    })
    assert codes(got) == sorted([
        ("regulated_entities", "UNSUPPORTED_MODEL_SPAN", False), ("regulated_entities", "UNSUPPORTED_MODEL_SPAN", False), ("penalties", "UNSUPPORTED_MODEL_SPAN", False),
        ("rules[0].action", "INVALID_OCCURRENCE_CORRECTED", True), ("rules[0].actor", "UNSUPPORTED_MODEL_SPAN", False), ("rules[0].conditions", "AMBIGUOUS_OR_INVALID_OCCURRENCE", False),
        ("rules[0].monetary_threshold_refs", "INVALID_CANDIDATE_REFERENCE", False), ("rules[0].percentage_threshold_refs", "INVALID_CANDIDATE_REFERENCE", False),
        ("rules[1].action", "AMBIGUOUS_OR_INVALID_OCCURRENCE", False), ("rules[3].action", "AMBIGUOUS_OR_INVALID_OCCURRENCE", False),
    ])
    assert {r.rule for r in got["rules"]} == {0, 2} and {(r.text, r.start) for r in got["quotes"]} == {("again", TWICE.index("again")), ("may", TWICE.rindex("may")), ("renew", TWICE.rindex("renew"))}


@pytest.mark.parametrize("raw", ["not json", None, "[1]", '{"rules": 3}', '{"document_id": "d"}', '{"rules": [{"modality": "x", "action": {"text": "may", "start": 3}}]}',
                                 '{"rules": [{"modality": "x", "action": {"text": "may"}, "id": 3}]}', '{"rules": [{"modality": "x"}]}', '{"penalties": [{"occurrence": 1}]}'])
def test_what_is_no_proposal(run, raw):
    got = run(TWICE, raw)
    assert codes(got) == [("provider", "INVALID_PROVIDER_JSON", False)] and not got["rules"] and not got["quotes"]


def test_no_registry_accepts_nothing(run):
    got = run(TWICE, {"regulated_entities": [{"text": "again"}], "deadline_refs": ["T001"], "rules": [{"modality": "permission", "action": {"text": "again"}, "actor": {"text": "may"}}]}, known=())
    assert {c for _, c, _ in codes(got)} == {"MISSING_REGISTRY"} and len(got["diagnostics"]) == 3 and not (got["rules"] or got["quotes"] or got["references"])


def test_places_against_brute_force(spark):
    from pyspark.sql import functions as F

    from tamarisk.operators.proposals import places

    rng = random.Random(1)
    rows = [("".join(rng.choice("ab\\E.é𝒳") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab\\E.é𝒳") for _ in range(rng.randint(0, 3)))) for _ in range(1500)]
    rows += [("aaaa", "aa"), ("", ""), ("a", "b"), (r"x\Ey\E", r"\E")]
    frame = spark.createDataFrame(rows, "t string, q string")
    for r in frame.select("t", "q", places(F.col("t"), F.col("q")).alias("at")).collect():
        assert r["at"] == ([i for i in range(len(r.t)) if r.t.startswith(r.q, i)] if r.q else []), (r.t, r.q)
