"""Stored queries and the stages that run for them."""

import pytest


@pytest.mark.parametrize("how", ["left_semi", "inner"])
def test_no_stage_outlives_a_stored_query_with_an_empty_side(spark, tmp_path, how):
    """Its shuffle files go when it ends, so a stage that still ran would ask for files that are gone."""
    from tamarisk.llm.common import mapped, stored

    def slow(batches):
        import time
        import uuid

        for batch in batches:
            time.sleep(0.5)
            (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch

    key = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    # the other side is found empty while the stage behind this exchange has most of its tasks before it
    rows = mapped(spark.range(0, 1000, 1, 1).repartition(16), slow, "id long")
    none = mapped(spark.range(0, 10, 1, 1), lambda batches: (b.slice(0, 0) for b in batches), "id long")
    assert stored(rows.join(none.hint("merge"), "id", how), "joined").count() == 0
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 1000
    assert spark.conf.get(key, None) == before
