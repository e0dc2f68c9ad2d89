"""Region measures on literal pages and against plain versions."""

import difflib
import itertools
import random

from pyspark.sql import functions as F

GOLD = "page long, region string, place int, kind string, text string, g_x0 double, g_y0 double, g_x1 double, g_y1 double"
BLOCKS = "page long, block int, order int, kind string, text string, x0 double, y0 double, x1 double, y1 double"


def test_a_page_by_hand(spark):
    from tamarisk.operators.regions import anchored_measures

    gold = [(1, "h", 0, "heading", "Title", 0.0, 0.0, 100.0, 10.0), (1, "a", 1, "article_label", "المادة الثانية", 0.0, 20.0, 100.0, 30.0), (1, "t", 2, "text", "two words صفحة 7", 0.0, 40.0, 100.0, 60.0),
            (1, "b", 3, "article_label", "المادة الخامسة", 0.0, 70.0, 100.0, 80.0), (2, "x", 0, "text", None, 0.0, 0.0, 1.0, 1.0)]
    blocks = [(1, 0, 2, "heading", "Title", 1.0, 1.0, 50.0, 9.0), (1, 1, 1, "text", "المادة ٢", 1.0, 21.0, 50.0, 29.0), (1, 2, 4, "text", "words", 1.0, 41.0, 50.0, 49.0), (1, 3, 3, "text", "two", 1.0, 50.0, 50.0, 59.0),
              (1, 4, 5, "heading", "المادة 6", 1.0, 71.0, 50.0, 79.0), (1, 5, 6, "heading", "stray", 500.0, 500.0, 600.0, 600.0), (1, 6, 7, "text", "no box", None, None, None, None)]
    got = {r.page: r for r in anchored_measures(spark.createDataFrame(gold, GOLD), spark.createDataFrame(blocks, BLOCKS)).collect()}
    r = got[1]
    assert (r.regions, r.heading_precision, r.heading_recall, r.heading_f1) == (4, round(1 / 3, 8), 1.0, 0.5)
    assert (r.article_exact, r.article_semantic, r.article_errors, r.page_references) == (0.0, 0.5, 1, 0.75)
    assert r.hypothesis == "Title المادة ٢ two words المادة 6" and r.order_accuracy == round(5 / 6, 8)
    assert (got[2].regions, got[2].heading_precision, got[2].order_accuracy, got[2].hypothesis) == (1, 1.0, 1.0, "")


def test_boxes_from_the_bottom(spark):
    from tamarisk.operators.regions import top_left

    rows = spark.createDataFrame([(1, 10.0, 30.0, 100.0, True), (2, 10.0, 30.0, 100.0, False)], "id long, y0 double, y1 double, h double, up boolean")
    assert {(r.id, r.y0, r.y1) for r in top_left(rows, "h", F.col("up")).collect()} == {(1, 70.0, 90.0), (2, 10.0, 30.0)}


def test_ratio_and_longest_order(spark):
    from tamarisk.operators.regions import in_order, order_ratio

    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcde", k=rng.randint(0, 12))), " ".join(rng.choices("abcde", k=rng.randint(0, 12)))) for _ in range(60)] + [(None, "a"), (None, None)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", order_ratio(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == difflib.SequenceMatcher(None, (r.a or "").split(), (r.b or "").split()).ratio()
    pages = {p: rng.sample(range(50), rng.randint(1, 8)) for p in range(30)}
    got = {r.p: (r.n, r.kept) for r in in_order(spark.createDataFrame([(p, i, g) for p, gs in pages.items() for i, g in enumerate(gs)], "p long, i int, g int"), "p", "i", "g").collect()}
    for p, gs in pages.items():
        best = max(k for k in range(1, len(gs) + 1) for c in itertools.combinations(gs, k) if list(c) == sorted(c))
        assert got[p] == (len(gs), best)


def test_pages_are_dealt_once_a_side(spark, small):
    from tamarisk.queries.regions import anchored_measures

    plan = anchored_measures(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Join") == 1


def test_odd_pages(spark):
    """Repeated regions and blocks, null names and kinds: a repeated block has one owner, regions of one name share their blocks."""
    from tamarisk.operators.regions import anchored_measures

    gold = [(1, "a", 0, "heading", "A", 0.0, 0.0, 10.0, 10.0), (1, "a", 1, None, "B", 0.0, 20.0, 10.0, 30.0), (1, None, 2, "heading", "C", 0.0, 40.0, 10.0, 50.0), (None, "n", 0, "heading", "N", 0.0, 0.0, 9.0, 9.0)]
    blocks = [(1, 7, 1, "heading", "x", 1.0, 1.0, 9.0, 9.0), (1, 7, 0, "heading", "y", 1.0, 21.0, 9.0, 29.0), (1, None, 2, "heading", "z", 1.0, 41.0, 9.0, 49.0), (None, 1, 0, "heading", "q", 1.0, 1.0, 8.0, 8.0)]
    got = {r.page: r for r in anchored_measures(spark.createDataFrame(gold, GOLD), spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert (got[1].regions, got[1].reference, got[1].hypothesis, got[1].heading_precision, got[1].heading_recall) == (3, "A B C", "y x y x ", 0.5, 0.5)
    assert (got[None].regions, got[None].hypothesis, got[None].heading_recall, got[None].order_accuracy) == (1, "", 0.0, 1.0)
