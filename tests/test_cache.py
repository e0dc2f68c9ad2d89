"""Results by the content they came from: only what changed is worked out again."""

import glob
import os

from pyspark.sql import functions as F


def state(spark, path, docs, notes, run=None, fail=False):
    from tamarisk.sources.cache import cached

    items, lines = spark.createDataFrame([(i,) for i in docs], "id long"), spark.createDataFrame([(i, t) for i, t in docs.items()], "id long, text string")
    extra = spark.createDataFrame(notes or [], "id long, note string")

    def step(todo):
        if fail:
            raise RuntimeError("lost")
        # one row a word; a document without words has none
        return todo.join(lines, "id").select("id", F.explode(F.split("text", " ")).alias("word")).where("word != ''")

    got, marks = cached(items, "id", {"lines": lines, "notes": extra}, path, run or {"k": 1}, step)
    return sorted((r.id, r.word) for r in got.collect()), {r.id for r in marks.where("rebuilt").collect()}


def test_only_changed_items_are_worked_out(spark, tmp_path):
    path, docs, notes = str(tmp_path / "c"), {1: "a b", 2: "c", 3: ""}, [(1, "x"), (1, "y"), (2, "x")]
    words = [(1, "a"), (1, "b"), (2, "c")]
    assert state(spark, path, docs, notes) == (words, {1, 2, 3})
    assert state(spark, path, docs, notes[::-1]) == (words, set())
    assert state(spark, path, docs, [*notes, (3, "z")]) == (words, {3})
    assert state(spark, path, docs, [*notes, (1, "x"), (3, "z")]) == (words, {1})
    assert state(spark, path, {**docs, 2: "d"}, [*notes, (1, "x"), (3, "z")]) == ([(1, "a"), (1, "b"), (2, "d")], {2})
    assert state(spark, path, docs, notes) == (words, set())  # what came back is still there
    assert state(spark, path, docs, notes, {"k": 2}) == (words, {1, 2, 3})
    assert state(spark, path, {2: "c"}, notes) == ([(2, "c")], set())


def test_nulls_and_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    assert state(spark, path, {5: ""}, None) == ([], {5}) and state(spark, path, {5: ""}, None) == ([], set())
    assert state(spark, path, {5: None}, None) == ([], {5})


def test_failed_jobs_and_damaged_rows(spark, tmp_path):
    path, docs = str(tmp_path / "c"), {1: "a b", 2: "c"}
    assert state(spark, path, docs, None)[1] == {1, 2}
    # rows of a job that failed before it was done: another batch, not named
    rows = spark.read.parquet(f"{path}/results")
    rows.limit(1).withColumn("batch", F.lit("lost")).withColumn("word", F.lit("ghost")).write.mode("append").parquet(f"{path}/results")
    assert state(spark, path, docs, None) == ([(1, "a"), (1, "b"), (2, "c")], set())
    good = spark.read.parquet(f"{path}/results").where("batch != 'lost'").collect()
    for f in glob.glob(f"{path}/results/*"):
        os.remove(f)
    spark.createDataFrame([(r.id, "X" if r.word == "c" else r.word, r.digest, r.batch) for r in good], "id long, word string, digest string, batch string").write.mode("append").parquet(f"{path}/results")
    spark.catalog.clearCache()
    assert state(spark, path, docs, None) == ([(1, "a"), (1, "b"), (2, "c")], {2})
    try:
        state(spark, path, {1: "new"}, None, fail=True)
        raise AssertionError
    except RuntimeError:
        pass
    assert state(spark, path, {1: "new"}, None) == ([(1, "new")], {1})
    assert "text" not in spark.read.parquet(f"{path}/done").columns
