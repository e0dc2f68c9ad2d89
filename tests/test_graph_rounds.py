"""Components: a few edges are ended by one task, more by rounds, with the same result."""

import random

import pytest


@pytest.mark.parametrize("few", [0, 40, 15_000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    from tamarisk.operators import graph

    monkeypatch.setattr(graph, "FEW", few)
    rng, made = random.Random(2), []
    order = [f"v{i:03}" for i in range(120)]
    rng.shuffle(order)
    edges = list(zip(order[:60], order[1:60])) + [(order[60], x) for x in order[61:119]] + [("z", "z"), (None, "z")]
    keep = lambda frame: made.append(1) or frame.localCheckpoint()
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string"), keep).collect()}
    assert got == {v: min(order[:60]) for v in order[:60]} | {v: min(order[60:119]) for v in order[60:119]}
    # without the last task every round is written, however few edges are left
    assert len(made) == 1 if few > 1000 else len(made) > 3
