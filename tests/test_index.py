"""The lexical index against plain scores: identifiers of any type, ties, nulls, filters, sets of queries, and how much it reads."""

import math
import random
import re
from collections import Counter

import pytest

TOKEN = re.compile(r"\w+|[^\w\s]")


def plain(rows, queries, k, eligible=None):
    """All scores of every query, the k best: by score, nulls before other identifiers, then identifiers."""
    docs = [(i, Counter(TOKEN.findall(t or ""))) for i, t in rows]
    n, average = len(docs), max(sum(sum(c.values()) for _, c in docs) / max(len(docs), 1), 1.0)
    df = Counter(t for _, c in docs for t in c)
    bm25, jaccard = set(), set()
    for q, text in queries:
        asked = Counter(TOKEN.findall(text or ""))
        scored, alike = [], []
        for i, c in docs:
            both = [t for t in asked if t in c]
            if not both:
                continue
            length = sum(c.values())
            if eligible is None or i in eligible:
                scored.append((i, round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / average)) * asked[t] for t in both), 8)))
            alike.append((i, round(len(both) / (len(asked) + len(c) - len(both)), 8)))
        for out, got in ((bm25, scored), (jaccard, alike)):
            got.sort(key=lambda x: (-x[1], x[0] is not None, x[0]))
            out |= {(q, i, round(s, 6), r) for r, (i, s) in enumerate(got[:k], 1)}
    return bm25, jaccard


def rows_of(frame):
    return {(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words, weights = [f"w{r}" for r in range(3000)], [1 / (r + 5) for r in range(3000)]
    some = lambda n: " ".join(rng.choices(words, weights, k=n))
    return [some(rng.randint(1, 60)) for _ in range(5000)], [some(rng.randint(1, 6)) for _ in range(25)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rankings_by_index(spark, tmp_path, texts, kind):
    from tamarisk.operators import postings

    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i:05d}")
    rows = [(name(i), t) for i, t in enumerate(texts[0])] + [(None, texts[0][3]), (name(90_001), None), (name(90_002), ""), (name(90_003), texts[0][3])]
    asked = [*enumerate(texts[1]), (100, texts[0][3]), (101, "none of these"), (102, None), (103, "")]
    corpus = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    queries = spark.createDataFrame([*asked, (None, "w1")], "query_id long, text string")
    index = postings.build(corpus, str(tmp_path / "index"))
    bm25, jaccard = plain(rows, asked, 7)
    counts, few = {}, {}
    assert rows_of(postings.bm25_top_k(index, queries, 7, counts=counts)) == bm25
    assert rows_of(postings.jaccard_top_k(index, queries, 7)) == jaccard
    assert 0 < counts["read"] < 0.75 * counts["blocks"]
    # a rare word beside common ones: most blocks of the common ones are passed over
    told = [(i, f"w{1000 + 70 * i} w{900 + 90 * i} w0 w1 w3") for i in range(20)]
    assert rows_of(postings.bm25_top_k(index, spark.createDataFrame(told, "query_id long, text string"), 2, counts=few)) == plain(rows, told, 2)[0]
    assert 0 < few["read"] < few["blocks"] / 2
    some = [i for i, _ in rows[::3]]
    eligible = spark.createDataFrame([(i,) for i in some], f"doc_id {kind}")
    assert rows_of(postings.bm25_top_k(index, queries, 5, eligible=eligible)) == plain(rows, asked, 5, set(some))[0]
    again = postings.opened(spark, str(tmp_path / "index"))
    assert again.count == len(rows) and rows_of(postings.bm25_top_k(again, queries, 7)) == bm25


def test_queries_in_sets_give_the_same(spark, tmp_path, texts, monkeypatch):
    from tamarisk.operators import postings

    rows, asked = list(enumerate(texts[0][:400])), list(enumerate(texts[1]))
    index = postings.build(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index"))
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = plain(rows, asked, 4)
    monkeypatch.setattr(postings, "MOST_QUERIES", 6)
    assert (rows_of(postings.bm25_top_k(index, queries, 4)), rows_of(postings.jaccard_top_k(index, queries, 4))) == want
    monkeypatch.setattr(postings, "SCORES", 1)
    assert rows_of(postings.bm25_top_k(index, queries, 4)) == want[0]


def test_small_and_empty_corpora(spark, tmp_path):
    from tamarisk.operators import lexical, postings

    corpus = spark.createDataFrame([("c", "alpha beta"), ("a", "alpha alpha"), ("b", "beta")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    hits = lexical.bm25_top_k(corpus, q, 3).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == ["a", "c"] and hits[0].score > hits[1].score
    assert [h.doc_id for h in lexical.jaccard_top_k(corpus, q, 3).orderBy("rank").collect()] == ["a", "c"]
    for bad in ({"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            lexical.bm25_top_k(corpus, q, 3, **bad)
    with pytest.raises(ValueError):
        lexical.bm25_top_k(corpus, q, 0)
    empty = postings.build(corpus.limit(0), str(tmp_path / "empty"))
    assert postings.bm25_top_k(empty, q, 3).count() == 0 and postings.jaccard_top_k(empty, q.limit(0), 3).count() == 0


def test_index_of_a_folder_follows_its_files(spark, tmp_path):
    from tamarisk.queries.tables import corpus_index

    at = str(tmp_path / "documents.parquet")
    frame = lambda n: spark.createDataFrame([(i, "a b", "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string")
    frame(3).write.parquet(at)
    first = corpus_index(spark, str(tmp_path))
    assert corpus_index(spark, str(tmp_path)) is first and first.count == 3
    frame(4).write.mode("overwrite").parquet(at)
    assert corpus_index(spark, str(tmp_path)).count == 4


def test_rankings_are_searched_once(spark):
    """Later uses of a ranking read its rows: no step of the search is in their plan, and joins know how few they are."""
    from tamarisk.operators import lexical

    corpus = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "word3 other1"), (2, "other2")], "query_id long, text string")
    for search in (lexical.bm25_top_k, lexical.jaccard_top_k):
        ranking = search(corpus, queries, 4)
        plan = ranking._jdf.queryExecution().optimizedPlan()
        assert "MapInArrow" not in plan.toString() and plan.stats().sizeInBytes() < 1_000_000
        assert ranking.count() == 8


def test_shallow_rankings_are_beginnings_of_deep_ones(spark, small):
    from tamarisk.operators import postings
    from tamarisk.queries import retrieval
    from tamarisk.queries.tables import benchmark, corpus_index

    deep = retrieval.bm25_ranking(spark, small, 50)
    shallow = retrieval.bm25_ranking(spark, small, 3)
    assert set(shallow.inputFiles()) == set(deep.inputFiles())
    assert sorted(map(tuple, shallow.collect())) == sorted(map(tuple, postings.bm25_top_k(corpus_index(spark, small), benchmark(spark, small), 3).collect()))


def test_eligible_documents_are_a_mask_and_no_join_of_blocks(spark, tmp_path, monkeypatch):
    from tamarisk.operators import postings

    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 9))) for i in range(200)]
    asked = [(0, "w1 w2 w3"), (1, "w4 w0")]
    index = postings.build(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index"))
    met, best = [], postings._best
    monkeypatch.setattr(postings, "_best", lambda blocks, *a: met.append(blocks) or best(blocks, *a))
    some = list(range(0, 200, 7))
    got = rows_of(postings.bm25_top_k(index, spark.createDataFrame(asked, "query_id long, text string"), 5, eligible=spark.createDataFrame([(i,) for i in some], "doc_id long")))
    assert got == plain(rows, asked, 5, set(some))[0]
    plan = met[0]._jdf.queryExecution().optimizedPlan().toString()
    assert met[0].where("term = -2").count() > 0 and plan.count("Join") == 1 and "filter(" not in plan
