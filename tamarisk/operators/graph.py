"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.lineage import rewritten

#: Contracted edges that one task joins at the end; more go through another round.
FEW = 15_000


def _joined(edges: DataFrame) -> DataFrame:
    """``id, m`` of a few edges' ends: the least of those they are connected with."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], ["id", "m"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.repartition(1).mapInArrow(run, f"id {kind}, m {kind}")


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = rewritten) -> DataFrame:
    """``id, component`` (the least identifier) of every vertex of ``edges(a, b)``.

    Each round every vertex joins the neighbour, or itself, that a hash of the round ranks first, so chains shrink by a
    share of their length too; edges move to what their ends became, until none is left. A round is one grouped minimum
    and two joins over the edges that remain, and when these are ``FEW`` one task ends them; ``keep`` cuts their lineage and what is estimated of their sizes. Loops and repeated edges do no harm; null ends are
    ignored; no edges give no rows.
    """
    edges = keep(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = edges.count()
    if left <= FEW:
        return _joined(edges).withColumnRenamed("m", "component")
    labels, number = None, 0
    while left:
        number += 1
        if left <= FEW:
            step, moved = keep(_joined(edges)), None
        else:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("m"))  # noqa: E731, B023
            first = F.least(rank("a"), rank("b"))
            ends = edges.select(F.col("a").alias("id"), first.alias("f")).union(edges.select(F.col("b").alias("id"), first.alias("f")))
            step = keep(ends.groupBy("id").agg(F.min("f").alias("f")).select("id", F.col("f.m").alias("m")))
            moved = edges.join(step.selectExpr("id as a", "m as x"), "a").join(step.selectExpr("id as b", "m as y"), "b").where("x != y")
        if labels is None:
            labels = step.withColumnRenamed("m", "component")
        else:
            labels = labels.join(step.withColumnRenamed("id", "component"), "component", "left")
            labels = labels.select("id", F.coalesce("m", "component").alias("component"))
        if moved is None:
            break
        edges = keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        left = edges.count()
        if number % 4 == 0:
            labels = keep(labels)
    labels = keep(labels)
    least = keep(labels.groupBy("component").agg(F.min(F.least("id", "component")).alias("least")))
    return labels.join(least, "component").select("id", F.col("least").alias("component"))
