"""Measures of a parsed page against gold regions: blocks belong to regions by where they lie, and texts, order and kinds are compared only then.

Gold regions have ``page, region, place`` (their order), ``kind``, ``text`` and a box ``g_x0`` to ``g_y1``; blocks have ``page, block, order, kind, text`` and a box ``x0`` to ``y1``, both in one
system of coordinates. A region takes the blocks that ``corpus.box_matches`` would give it, in reading order; where several regions take a block it is owned by the first of them. Pages are joined by their
name alone, so what meets is a page's regions and blocks. Null texts are empty, and blocks without a box belong nowhere.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.corpus import box_cover
from tamarisk.operators.labels import parsed_label
from tamarisk.operators.review import page_references

HEADING, ARTICLE = "heading", "article_label"
#: The share of a block that a region must cover to take it.
LEAST = 0.2


def top_left(frame: DataFrame, height: str, bottom_left: Column) -> DataFrame:
    """Boxes measured from the bottom of their page (where ``bottom_left`` says so) as boxes measured from its top."""
    turned = lambda a, b: F.when(bottom_left, F.col(height) - F.col(b)).otherwise(F.col(a)).alias(a)
    return frame.select(*[c for c in frame.columns if c not in ("y0", "y1")], turned("y0", "y1"), turned("y1", "y0"))


def _gathered(rows: DataFrame, name: str, columns: list[Column]) -> DataFrame:
    return rows.groupBy("page").agg(F.collect_list(F.struct(*columns)).alias(name))


def pages_of(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """``page, texts, stray, order``: a row a page with gold regions, all of which is made from the page's own regions and blocks.

    ``texts`` has ``place, region, kind, reference, hypothesis, has_heading`` of every region, where one without blocks has an empty hypothesis; ``stray`` is how many headings no
    heading owns, ``order`` the share of owning regions' pairs whose first blocks stand in the regions' order, null where there are no pairs.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    g = _gathered(gold, "_gold", [*map(F.col, ("place", "region", "kind", "g_x0", "g_y0", "g_x1", "g_y1")), text])
    b = _gathered(blocks, "_all", [*map(F.col, ("block", "order", "kind", "x0", "y0", "x1", "y1")), text])
    rows = g.join(b, "page", "left").select("page", "_gold", F.coalesce("_all", F.array().cast(b.schema["_all"].dataType)).alias("_blocks"))

    def taken(region: Column) -> Column:
        def fits(block: Column) -> Column:
            covered, centre = box_cover(lambda c: block[c], lambda c: region[c])
            return (covered >= LEAST) | centre

        one = lambda x: F.struct(region["place"].alias("place"), region["region"].alias("region"), region["kind"].alias("kind"), *[x[c].alias(c) for c in ("order", "block", "text")], x["kind"].alias("block_kind"))
        return F.transform(F.filter("_blocks", fits), one)

    # in the order of regions, so the first row of a block is its owner's
    rows = rows.withColumn("_found", F.array_sort(F.flatten(F.transform("_gold", taken))))
    owner = lambda x, at: ~F.exists(F.slice("_found", F.lit(1), at), lambda y: y["block"].eqNullSafe(x["block"]))
    rows = rows.withColumn("_owned", F.filter("_found", owner))

    def texts(region: Column) -> Column:
        own = F.filter("_found", lambda x: x["region"] == region["region"])
        put = F.array_join(F.transform(F.array_sort(F.transform(own, lambda x: F.struct(x["order"], x["block"], x["text"].alias("text")))), lambda x: x["text"]), " ")
        heading = F.coalesce(F.exists(own, lambda x: x["block_kind"] == HEADING), F.lit(False))
        return F.struct(*[region[c].alias(c) for c in ("place", "region", "kind")], region["text"].alias("reference"), F.trim(put).alias("hypothesis"), heading.alias("has_heading"))

    kept = lambda x: F.coalesce(F.exists("_owned", lambda y: (y["block"] == x["block"]) & (y["kind"] == HEADING)), F.lit(False))
    place = lambda x: F.struct(x["place"].alias("place"), x["region"].alias("region"))
    begins = lambda p: F.array_min(F.transform(F.filter("_owned", lambda x: place(x) == p), lambda x: F.struct(x["order"].alias("order"), x["block"].alias("block"))))
    # a row of _found comes after those of earlier regions, so distinct places are in order too
    rows = rows.withColumn("_firsts", F.transform(F.array_distinct(F.transform("_owned", place)), begins))
    before = lambda x, at: F.size(F.filter(F.slice("_firsts", F.lit(1), at), lambda y: y < x))
    n = F.size("_firsts").cast("long")
    right = F.aggregate(F.transform("_firsts", before), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "page", F.transform("_gold", texts).alias("texts"), F.size(F.filter("_blocks", lambda x: (x["kind"] == HEADING) & ~kept(x))).alias("stray"),
        F.when(n > 1, F.round(right / (n * (n - 1) / 2), 8)).alias("order"),
    )


def anchored_measures(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row a page with gold regions: ``regions, heading_precision, heading_recall, heading_f1, article_exact, article_semantic, article_errors, order_accuracy, page_references,
    reference, hypothesis`` (the regions' texts in order, for error rates)."""
    # a page's regions and blocks meet once; the regions of a page stay together, so nothing is dealt again to be summed
    texts = pages_of(gold, blocks).select("page", F.col("stray").alias("_fp"), F.col("order").alias("_order"), F.explode("texts").alias("t")).select("page", "_fp", "_order", "t.*")
    is_heading, share = F.col("kind") == HEADING, lambda a, n: F.round(a / F.greatest(n, F.lit(1)), 8)
    wanted = parsed_label(F.trim("reference"))["ordinal"]
    got = parsed_label(F.trim("hypothesis"))["ordinal"]
    numbered = (F.col("kind") == ARTICLE) & wanted.isNotNull()
    texts = texts.withColumn("_n", numbered).withColumn("_right", numbered & wanted.eqNullSafe(got)).withColumn("_refs", F.size(F.array_except(page_references(F.col("reference")), page_references(F.col("hypothesis")))) == 0)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "region", F.col(c).alias("t")))), lambda x: x["t"]), " ").alias(c)
    pages = texts.groupBy("page").agg(
        F.count("*").alias("regions"), F.count_if(is_heading).alias("_h"), F.count_if(is_heading & F.col("has_heading")).alias("_tp"),
        F.count_if("_n").alias("_a"), F.count_if(F.col("_n") & (F.trim("reference") == F.trim("hypothesis"))).alias("_exact"), F.count_if("_right").alias("_semantic"),
        F.count_if("_refs").alias("_pages"), joined("reference"), joined("hypothesis"), F.max("_fp").alias("_fp"), F.max("_order").alias("_order"),
    )
    precision = F.when(F.col("_tp") + F.col("_fp") > 0, F.round(F.col("_tp") / (F.col("_tp") + F.col("_fp")), 8)).when(F.col("_h") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("_h") > 0, F.round(F.col("_tp") / F.col("_h"), 8)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, F.round(2 * precision * recall / (precision + recall), 8)).otherwise(0.0)
    return pages.select(
        "page", "regions", precision.alias("heading_precision"), recall.alias("heading_recall"), f1.alias("heading_f1"), share(F.col("_exact"), F.col("_a")).alias("article_exact"),
        share(F.col("_semantic"), F.col("_a")).alias("article_semantic"), (F.col("_a") - F.col("_semantic")).alias("article_errors"), F.coalesce("_order", F.lit(1.0)).alias("order_accuracy"),
        share(F.col("_pages"), F.col("regions")).alias("page_references"), "reference", "hypothesis",
    )


def order_ratio(reference: Column, hypothesis: Column) -> Column:
    """How alike two texts are as sequences of words: twice what matching blocks hold over the words of both."""

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([difflib.SequenceMatcher(None, (x or "").split(), (y or "").split()).ratio() for x, y in pairs], pa.float64())

    return ratio(reference, hypothesis)


def in_order(frame: DataFrame, page: str, wanted: str, got: str) -> DataFrame:
    """``page, n, kept``: a page's blocks, and how many of them stand in the wanted order at most: the longest run of growing places, by patience; the others are out of place."""
    rows = frame.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(wanted).alias("w"), F.col(got).alias("g")))).alias("all"))

    @F.arrow_udf("int")
    def longest(places: pa.Array) -> pa.Array:
        from bisect import bisect_left

        out = []
        for row in places.to_pylist():
            piles: list[int] = []
            for g in row:
                at = bisect_left(piles, g)
                piles[at : at + 1] = [g]
            out.append(len(piles))
        return pa.array(out, pa.int32())

    return rows.select(page, F.size("all").alias("n"), longest(F.transform("all", lambda x: x["g"].cast("long"))).alias("kept"))
