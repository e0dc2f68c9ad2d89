"""Greedy choices whose next step depends on the last: each runs over one bounded group (a page, or a reduced one)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diverse(frame: DataFrame, by: str, fields: list[str], key: str, n: int, seed: int | str) -> DataFrame:
    """Of each group n rows, each time the one with most values not yet seen; ties by seeded digest. ``pick`` from 1.

    Rows with the same values only differ in their digest, so of each combination of a group no more than the first n can be
    picked; those alone meet in a task.
    """
    chance = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = F.row_number().over(Window.partitionBy(by, *fields).orderBy(chance))
    frame = frame.withColumn("_first", first).where(F.col("_first") <= n).drop("_first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {i: (tuple(r), hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()) for i, (r, k) in enumerate(zip(pdf[fields].astype(str).itertuples(index=False), pdf[key]))}
        seen: list[set] = [set() for _ in fields]
        order = []
        while left and len(order) < n:
            best = min(left, key=lambda i: (-sum(v not in s for v, s in zip(left[i][0], seen)), left[i][1]))
            for v, s in zip(left.pop(best)[0], seen):
                s.add(v)
            order.append(best)
        return pdf.iloc[order].assign(pick=range(1, len(order) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", pick int"
    return frame.groupBy(by).applyInPandas(run, schema)


def matched_blocks(gold: DataFrame, found: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """``page, gold_id, block_id, how``: equal names first, then nameless blocks by their greatest overlap of at least ``least``.

    Both sides have ``place`` (their order), ``name`` and a box x0, y0, x1, y1; a block matches once. Rows that share a place
    are blocks of their own, in the order of their boxes. The nth block of a name meets the nth of that name on the other side;
    pages' nameless blocks are matched many pages a batch, as each choice depends on those before.
    """
    box = ["x0", "y0", "x1", "y1"]
    nth = F.row_number().over(Window.partitionBy(page, "name").orderBy("place", *box))
    a, b = (side.where("name is not null").select(page, "name", nth.alias("nth"), F.col("place").cast("long").alias(c)) for side, c in ((gold, "gold_id"), (found, "block_id")))
    named = a.join(b, [page, "name", "nth"]).select(page, "gold_id", "block_id", F.lit("name").alias("how"))

    block = F.struct(F.col("place").cast("long").alias("place"), *[F.col(c).cast("double").alias(c) for c in box])
    sides = [side.where("name is null").select(page, F.lit(i).alias("side"), block.alias("block")) for i, side in enumerate((gold, found))]
    pages = sides[0].unionByName(sides[1]).groupBy(page).agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("block")))).alias(c) for i, c in enumerate("ab")])
    pages = pages.where("size(a) > 0 and size(b) > 0")

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_greedy(x, y, least) for x, y in zip(a, b)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    pairs = F.pandas_udf(run, "array<struct<gold_id:long,block_id:long>>")
    near = pages.select(page, F.explode(pairs("a", "b")).alias("p")).select(page, "p.gold_id", "p.block_id", F.lit("overlap").alias("how"))
    return named.unionByName(near)


def _greedy(wanted: list[dict], blocks: list[dict], least: float) -> list[dict]:
    """In order, each wanted box with the free block that covers most of their union, the first of equal ones, if that is at least ``least``."""
    free = [(b["x0"], b["y0"], b["x1"], b["y1"], (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), b["place"]) for b in blocks]
    out = []
    for w in wanted:
        x0, y0, x1, y1 = w["x0"], w["y0"], w["x1"], w["y1"]
        area, best, at = (x1 - x0) * (y1 - y0), -1.0, None
        for i, (u0, v0, u1, v1, other, _) in enumerate(free):
            shared = max(0.0, min(x1, u1) - max(x0, u0)) * max(0.0, min(y1, v1) - max(y0, v0))
            both = area + other - shared
            overlap = shared / both if both > 0 else 0.0
            if overlap > best:
                best, at = overlap, i
        if at is not None and best >= least:
            out.append({"gold_id": w["place"], "block_id": free.pop(at)[5]})
    return out
