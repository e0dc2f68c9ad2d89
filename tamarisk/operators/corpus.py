"""Canonical units of wide tables, and diagnostics of numbered groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivoted_units(frame: DataFrame, key: str, fields: list[str], metadata: list[str] = ()) -> DataFrame:
    """``doc_id, ordinal, unit_type, text, metadata``: one unit for each non-blank field, numbered as the fields are."""
    units = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f).alias("unit_type"), F.col(f).cast("string").alias("text")) for i, f in enumerate(fields)])
    meta = F.to_json(F.struct(*metadata)) if metadata else F.lit(None).cast("string")
    rows = frame.select(F.col(key).alias("doc_id"), meta.alias("metadata"), F.explode(units).alias("u")).select("doc_id", "u.*", "metadata")
    return rows.where("trim(text) != ''")


def group_contiguity(frame: DataFrame, group: str, ordinal: str) -> DataFrame:
    """``group, n, lowest, highest, contiguous``: whether a group's distinct ordinals leave no gap."""
    lo, hi = F.min(ordinal), F.max(ordinal)
    return frame.groupBy(group).agg(F.count("*").alias("n"), lo.alias("lowest"), hi.alias("highest"), (hi - lo + 1 == F.count_distinct(ordinal)).alias("contiguous"))


def group_status(frame: DataFrame, group: list[str], part: str, label: str, text: str) -> DataFrame:
    """Fragments of one key: unique, series (all parts named and distinct), continuation (by label) or conflicting."""
    n, parts = F.count("*"), F.count(part)
    status = (
        F.when(n == 1, "unique").when((parts == n) & (F.count_distinct(part) == n), "series").when(parts == n, "conflicting")
        .when(F.bool_or(F.col(label).rlike("(?i)continued|تابع")), "continuation").when(F.count_distinct(text) > 1, "conflicting").otherwise("unresolved")
    )
    return frame.groupBy(*group).agg(n.alias("n"), status.alias("status"))


def nearest_ordinals(wanted: DataFrame, frame: DataFrame, group: str, ordinal: str) -> DataFrame:
    """For each ``group, wanted`` the ordinal that is nearest, the smaller of two as near.

    As-of in both directions by windows over the union of both sides, so no pair of a group is ever enumerated.
    """
    both = wanted.select(group, F.col("wanted").alias("at"), F.lit(1).alias("asks")).unionByName(frame.select(group, F.col(ordinal).alias("at"), F.lit(0).alias("asks")).distinct())
    up = Window.partitionBy(group).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(group).orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("asks") == 0, F.col("at"))
    rows = both.select("*", F.last(own, True).over(up).alias("below"), F.last(own, True).over(down).alias("above")).where("asks = 1")
    near = F.when(F.col("above").isNull() | (F.col("at") - F.col("below") <= F.col("above") - F.col("at")), F.col("below")).otherwise(F.col("above"))
    return rows.select(group, F.col("at").alias("wanted"), near.alias("nearest"))


def suppressed(units: DataFrame, doc: str, kind: str, text: str, raw: str = "case_text") -> DataFrame:
    """Without the raw units of documents that have a structured one that isn't blank."""
    structured = F.max(((F.col(kind) != raw) & (F.trim(F.col(text)) != "")).cast("int")).over(Window.partitionBy(doc))
    return units.withColumn("_s", structured).where((F.col(kind) != raw) | (F.coalesce("_s", F.lit(0)) == 0)).drop("_s")


def box_matches(gold: DataFrame, blocks: DataFrame, page: str, least: float = 0.2) -> DataFrame:
    """Blocks of a gold region's page of which it covers a share of at least ``least``, or whose centre it holds.

    Boxes are x0, y0, x1, y1 columns, gold's with a ``g_`` before.
    """
    covered, centre = box_cover(F.col, F.col)
    return gold.join(blocks, page).withColumn("covered", F.round(covered, 8)).where((covered >= least) | centre)


def box_cover(block: Callable[[str], Column], gold: Callable[[str], Column]) -> tuple[Column, Column]:
    """The share of a block that a gold region covers, and whether it holds the block's centre; both are asked for their columns by name."""
    x0, y0, x1, y1 = (block(c) for c in ("x0", "y0", "x1", "y1"))
    g_x0, g_y0, g_x1, g_y1 = (gold(c) for c in ("g_x0", "g_y0", "g_x1", "g_y1"))
    w = F.greatest(F.lit(0.0), F.least(x1, g_x1) - F.greatest(x0, g_x0))
    h = F.greatest(F.lit(0.0), F.least(y1, g_y1) - F.greatest(y0, g_y0))
    area = (x1 - x0) * (y1 - y0)
    covered = F.when(area > 0, w * h / area).otherwise(0.0)
    return covered, ((x0 + x1) / 2).between(g_x0, g_x1) & ((y0 + y1) / 2).between(g_y0, g_y1)
