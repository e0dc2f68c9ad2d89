"""The library's own operators on literal cases; queries with SQL are held against DuckDB in test_oracles.py."""

import random

import pytest
from pyspark.sql import functions as F


def test_bm25_order_and_errors(spark):
    from tamarisk.operators.lexical import bm25, top_k

    corpus = spark.createDataFrame([("c", "alpha beta"), ("a", "alpha alpha"), ("b", "beta")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    hits = top_k(bm25(corpus, q, zeros=True), 3).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == ["a", "c", "b"] and hits[2].score == 0.0
    for bad in ({"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            bm25(corpus, q, **bad)
    with pytest.raises(ValueError):
        top_k(corpus, 0)


def test_fusion(spark):
    from tamarisk.operators.fusion import reciprocal_rank_fusion

    r = lambda *ids: spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(ids)], "query_id long, doc_id string, rank int")
    got = reciprocal_rank_fusion(r("a", "shared"), r("shared", "b"), 1.0, 1.0).orderBy("rank").collect()
    assert [(g.doc_id, g.provenance) for g in got] == [("shared", "both"), ("a", "sparse-only"), ("b", "dense-only")]
    assert abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12
    tied = reciprocal_rank_fusion(r("z"), r("a"), 0.0, 0.0).orderBy("rank").collect()
    assert [g.doc_id for g in tied] == ["a", "z"]
    assert reciprocal_rank_fusion(r(*map(str, range(60))), r("x")).count() == 20


def test_metrics(spark):
    from tamarisk.operators import metrics as m

    ranked = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate("abc")], "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (2, "z", 1)], "query_id long, doc_id string, grade int")
    at = {k: {r.query_id: r for r in m.query_metrics(ranked, qrels, k).collect()} for k in (1, 2, 5)}
    assert at[1][1].recall == 0.5 and at[5][1].recall == 1.0 and at[2][1].precision == 0.5 and at[5][1].mrr == 1.0
    assert at[5][2].recall == at[5][2].ndcg == at[5][2].mrr == 0.0
    pairs = spark.createDataFrame([(1, 0), (2, 3), (4, 2), (5, 5)], "l int, r int")
    w = m.wins_ties_losses(pairs, "l", "r").first()
    assert (w.wins, w.ties, w.losses, w.delta) == (2, 1, 1, 0.5)
    got = m.percentile_floor(spark.createDataFrame([(1, v) for v in range(10)], "g int, v int"), ["g"], "v", {"p": 0.95}, lambda n, p: F.floor((n - 1) * p)).first()
    assert got.p == 8
    for rule in ("ceil", "floor", "linear"):
        b = m.bootstrap(pairs.withColumn("g", F.lit(1)), "g", "l", "r", rule, 200).first()
        assert b.n == 4 and b.low <= b.delta <= b.high


def test_word_errors(spark):
    from tamarisk.operators.metrics import word_errors

    rows = [("a b c", "a x c d"), ("", ""), (None, "q"), ("kitten", "sitting")]
    got = word_errors(spark.createDataFrame(rows, "r string, c string"), "r", "c").collect()
    assert [g.wer for g in got] == [round(2 / 3, 8), 0.0, 1.0, 1.0] and got[3].cer == 0.5


def test_exact_spans():
    from tamarisk.operators.chunking import _TOKEN, exact_spans

    assert exact_spans("") == [] and exact_spans(" \n ") == []
    spans = exact_spans(" ".join(["word"] * 600))
    assert len(spans) == 2 and all(s[2] for s in spans) and spans[1][0] < spans[0][1]
    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choice(["word ", "x. ", "longer! ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 400)))
        got = exact_spans(t, 20, 30)
        held = set()
        for s, e, over in got:
            assert t[s:e].strip() and len(_TOKEN.findall(t[s:e])) <= 30
            held |= set(range(s, e))
        assert all(i in held for i, c in enumerate(t) if not c.isspace())
    with pytest.raises(ValueError):
        exact_spans("x", 5, 4)


def test_merged_spans(spark):
    from tamarisk.operators.chunking import merged_spans

    s = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (2, 3, 4)], "k int, start int, end int")
    assert {tuple(r) for r in merged_spans(s, "k").collect()} == {(1, 0, 7), (1, 9, 12), (2, 3, 4)}


def test_budget_admits_later_smaller_units(spark):
    from tamarisk.operators.grounding import blocks, within_budget

    u = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 30), (2, 1, 999)], "q int, rank int, cost int")
    assert {(r.q, r.rank): r.admitted for r in within_budget(u, "q", ["rank"], "cost", 100).collect()} == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): False}
    b = blocks(spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 5)], "d int, ordinal int"), ["d"])
    assert [r.block for r in b.orderBy("ordinal").collect()] == [1, 1, 2, 2]


def test_answerability_rules(spark):
    from tamarisk.operators.grounding import answerability

    rows = [("", 1, 1.0), ("Should I sign?", 1, 1.0), ("law of Egypt", 1, 1.0), ("is it in force", 1, 1.0), ("x", 0, 1.0), ("x", 1, 0.1), ("x", 1, 0.9), ("saudi law", 1, 0.9), ("laws of Egypt and the UAE", 1, 1.0)]
    d = spark.createDataFrame(rows, "q string, e int, c double")
    got = [r.x for r in d.select(answerability(F.col("q"), ["SA"], F.col("e"), F.col("c"), 0.5).alias("x")).collect()]
    assert got == ["requested_info_not_found", "personalized_legal_advice", "jurisdiction_mismatch", "currentness_unverified", "no_context", "low_retrieval_confidence", None, None, "jurisdiction_ambiguous"]
    of = lambda *a, **k: d.limit(1).select(answerability(F.lit("x"), ["SA"], F.lit(1), F.lit(1.0), context=F.array(*map(F.lit, a)).cast("array<string>"), **k).alias("x")).first()[0]
    assert of("SA") is None and of("sa") is None and of("EG") == "jurisdiction_mismatch" and of("SA", "EG") == "jurisdiction_ambiguous"


@pytest.mark.parametrize(
    ("text", "kind", "raw", "value"),
    [
        ("بتاريخ 12/3/1444هـ صدر", "date", "12/3/1444هـ", "1444-03-12"), ("وتاريخ ١/٨/١٤٤٥هـ", "date", "١/٨/١٤٤٥هـ", "1445-08-01"),
        ("غرامة 10,000 ريال", "money", "10,000 ريال", "10000 SAR"), ("نسبة 5.5%", "percentage", "5.5%", "5.5%"),
        ("خمسة في المائة", "percentage", "خمسة في المائة", "5%"), ("مدة ثلاثين يوماً", "duration", "ثلاثين يوماً", "30 days"),
        ("المادة الخامسة من", "article", "المادة الخامسة", "5"), ("المادة (١٢)", "article", "المادة (١٢)", "12"),
        ("المادة التاسعة والعشرين", "article", "المادة التاسعة والعشرين", "29"), ("خلال سنتين", "duration", "سنتين", "2 year"),
        ("أحد عشر يوماً", "duration", "أحد عشر يوماً", "11 days"), ("ثلاثة عشر شهرا", "duration", "ثلاثة عشر شهرا", "13 months"), ("(مائة وثمانين)يوماً", "duration", "(مائة وثمانين)يوماً", "180 days"),
        (")30( يوم", "duration", ")30( يوم", "30 days"), ("خمس مائة ريال", "money", "خمس مائة ريال", "500 SAR"), ("خمسة عشر ألف ريإل", "money", "خمسة عشر ألف ريإل", "15000 SAR"),
        ("والمادة (الثانية عشرة)", "article", "المادة (الثانية عشرة)", "12"), ("نظام مراقبة البنوك. ثم", "regulation", "نظام مراقبة البنوك", "نظام مراقبة البنوك"),
        ("اللائحة التنفيذية لإجراءات الاستئناف", "regulation", "اللائحة التنفيذية لإجراءات الاستئناف", "اللائحة التنفيذية لإجراءات الاستئناف"),
    ],
)
def test_extraction(text, kind, raw, value):
    from tamarisk.operators.extraction import spans_of

    found = [s for s in spans_of(text) if s["kind"] == kind]
    assert [(s["raw"].strip(), s["value"]) for s in found] == [(raw, value)]
    assert all(text[s["start"] : s["end"]] == s["raw"] for s in found)


def test_no_regulation_without_a_name_and_calendars():
    from tamarisk.operators.extraction import date_value, spans_of

    for text in ("نظام بعد تسعين", "لائحة كيفيةذلك", "نظام المالي وعدالة", "نظام الجلسة تبدأ", "(0015) (9075) (5 96)"):
        assert not [s for s in spans_of(text) if s["kind"] in ("regulation", "percentage")], text
    assert date_value("في 5 رمضان 1440") == ("1440-09-05", "normalized", "hijri") and date_value("12/03/2024") == ("2024-03-12", "normalized", "gregorian")
    assert date_value("45/03/2024")[:2] == (None, "partial")
    text = "يجب الإخطار خلال ۱۲ روزاً ولمدة شهر واحد."
    assert [s["value"] for s in spans_of(text)] == ["12 days", "1 month"]


def test_labels_of_candidates(spark):
    from tamarisk.operators.extraction import candidates, extracted

    docs = spark.createDataFrame([(1, "المادة (7) تنص على المادة (7) خلال ٣٠ يوماً في 1/2/1440هـ"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.label for r in candidates(docs).orderBy("start").collect()] == ["A001", "A002", "T001", "T002"]
    got = {r.doc_id: r for r in extracted(docs).collect()}
    assert len(got) == 3 and got[1].articles == ["A001", "A002"] and got[2].articles == [] and got[2].candidates is None


def test_numbers():
    from tamarisk.operators.extraction import plain_number

    assert [plain_number(x) for x in ("1,234.5", "1.234,5", "1,234", "1,5", "٠٠٧", "+3", "x")] == ["1234.5", "1234.5", "1234", "1.5", "7", "3", None]


def test_normal_forms(spark):
    from tamarisk.functions import text as T

    d = spark.createDataFrame([("﻿ مُحَمَّـد  إلى ١٢ ",)], "t string")
    raw, light, aggressive = (d.select(T.normalised(F.col("t"), p)).first()[0] for p in T.POLICIES)
    assert raw == "مُحَمَّـد إلى ١٢" and light == "محمد الى ١٢" and aggressive == "محمد الي 12"
    assert d.select(T.normalised(F.lit(aggressive), "aggressive")).first()[0] == aggressive
    assert d.select(T.composed(F.lit("é"))).first()[0] == "é"


def test_near_duplicate_texts_against_all_pairs(spark):
    from difflib import SequenceMatcher

    from tamarisk.operators.quality import near_duplicate_texts

    rng, rows = random.Random(4), []
    for _ in range(12):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 40))]
        for _ in range(4):
            v = list(w)
            if rng.random() < 0.7:
                v[rng.randrange(len(v))] = "zz"
            rows.append((len(rows), " ".join(v)))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.96}
    got = near_duplicate_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    assert {(r.a, r.b) for r in got} == want


def test_components_split(spark):
    from tamarisk.operators.sampling import component_split

    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 4 != 3], "a long, b long")
    got = component_split(e).collect()
    assert len({r.component for r in got}) == 10 and len(got) == 40
    assert all(len({r.split for r in got if r.component == c}) == 1 for c in {r.component for r in got})
    assert sum(r.split == "test" for r in got) == 12


def test_vectors(spark):
    from tamarisk.operators.dense import dense_top_k, encoded, hashed_encoder, invalid_vectors

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [0.6, 0.8]), (5, [0.6, 0.8]), (6, None)], "id long, vector array<float>")
    assert {(r.id, r.reason) for r in invalid_vectors(v, 2).collect()} == {(2, "not_normalised"), (3, "not_finite"), (4, "wrong_dimension"), (5, "duplicate_id"), (6, "null")}
    ok = v.where("id in (1, 2)")
    assert [(r.doc_id, r.score) for r in dense_top_k(ok, v.where("id = 1"), 1).collect()] == [(1, 1.0)]
    t = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    assert encoded(t, hashed_encoder(8), 8).count() == 2


def test_files(spark, tmp_path):
    from tamarisk.sources import files

    p = tmp_path / "a.csv"
    p.write_bytes(b"\xef\xbb\xbfid,text\n1,\"x\ny\"\n2,z\n")
    assert [tuple(r) for r in files.read_csv(spark, str(p)).collect()] == [("1", "x\ny"), ("2", "z")]
    d = files.file_digests(spark, str(tmp_path)).collect()
    assert d[0].has_bom and d[0].length == p.stat().st_size
    out = str(tmp_path / "out")
    f = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    files.write_parquet(f, out, ["s"])
    assert files.read_parquet(spark, out, ["id"]).count() == 2
    new = files.upserted(f, spark.createDataFrame([(9, "b")], "id long, s string"), "s")
    assert {tuple(r) for r in new.collect()} == {(1, "a"), (9, "b")}
    files.write_jsonl(f, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id long, s string").count() == 2
    assert [r.id for r in files.page(f, "id", 1, 5).collect()] == [2]
    with pytest.raises(ValueError):
        files.page(f, "id", 0, 101)


def test_streams_equal_their_batch_forms(spark, small, tmp_path):
    from tamarisk.streaming import events

    batch = spark.read.parquet(f"{small}/events.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = events.event_stream(spark, str(folder), batch.schema)
    got = events.drained(events.window_figures(stream, "event_type"), "figures", str(tmp_path / "c"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in events.window_figures(batch, "event_type").collect()}


def test_plans(spark, small):
    from tamarisk.plans.inspect import exchanges, pushed_filters, read_columns, runs_python

    li = spark.read.parquet(f"{small}/lineitem.parquet").where("l_quantity > 40").groupBy("l_partkey").count()
    assert exchanges(li) == 1 and not runs_python(li)
    assert any("l_quantity" in x for x in pushed_filters(li)) and read_columns(li) == {"l_partkey", "l_quantity"}


def test_article_labels(spark):
    from tamarisk.operators.labels import article_label, parsed_label

    cases = {
        "المادة الأولى": (1, None, None), "المادة ١٢": (12, None, None), "المادة الحادية عشرة": (11, None, None),
        "المادة الخامسة والعشرون (الجزء 2)": (25, 2, None), "المادة الثالثة بعد المائة": (103, None, None),
        "المادة العاشرة ملغاة": (10, None, "ملغاة"), "المادة الستون (جزء 2)": (60, 2, None), "Article 12 part 2": (None, 2, None), "الماده 5 مضافة": (5, None, "مضافة"),
        "المادة الرابعة والتسعون": (94, None, None), "المادة السابعة عشرة": (17, None, None), "نص المادة الأولى": (None, None, None), "المادة": (None, None, None), "": (None, None, None), "المادة 1000": (None, None, None),
    }
    for raw, want in cases.items():
        assert article_label(raw)[:3] == want, raw
    d = spark.createDataFrame([(x,) for x in [*cases, None]], "t string")
    assert [r.ordinal for r in d.select(parsed_label(F.col("t")).alias("p")).select("p.*").collect()] == [v[0] for v in cases.values()] + [None]


def test_block_matching(spark):
    from tamarisk.operators.picking import diverse, matched_blocks

    schema = "page int, place long, name string, x0 double, y0 double, x1 double, y1 double"
    gold = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 1.0, 1.0), (1, 1, None, 0.0, 0.0, 10.0, 10.0), (1, 2, None, 50.0, 50.0, 60.0, 60.0)], schema)
    found = spark.createDataFrame([(1, 7, None, 0.0, 1.0, 10.0, 10.0), (1, 8, "a", 90.0, 90.0, 99.0, 99.0), (1, 9, None, 0.0, 0.0, 5.0, 5.0)], schema)
    assert {tuple(r)[1:] for r in matched_blocks(gold, found, "page").collect()} == {(0, 8, "name"), (1, 7, "overlap")}
    rows = spark.createDataFrame([(1, i, "xy"[i % 2], "pqr"[i % 3]) for i in range(12)], "g int, k int, a string, b string")
    picked = diverse(rows, "g", ["a", "b"], "k", 3, 1).collect()
    assert {r.a for r in picked[:2]} == {"x", "y"} and len({r.b for r in picked}) == 3


def test_block_matching_of_shared_places(spark):
    """Blocks that share a place each match; many small pages go through one call of Python, not one each."""
    from tamarisk.operators.picking import matched_blocks

    schema = "page int, place long, name string, x0 double, y0 double, x1 double, y1 double"
    gold = spark.createDataFrame([(1, 1, None, 0.0, 0.0, 10.0, 10.0), (1, 1, None, 50.0, 50.0, 60.0, 60.0), (1, 3, "a", 0.0, 0.0, 1.0, 1.0), (1, 3, "a", 5.0, 5.0, 6.0, 6.0), (2, 1, "a", 0.0, 0.0, 1.0, 1.0)], schema)
    found = spark.createDataFrame([(1, 4, None, 50.0, 51.0, 60.0, 61.0), (1, 4, None, 0.0, 1.0, 10.0, 11.0), (1, 6, "a", 0.0, 0.0, 1.0, 1.0), (1, 6, "a", 0.0, 0.0, 1.0, 1.0), (3, 1, "a", 0.0, 0.0, 1.0, 1.0)], schema)
    got = matched_blocks(gold, found, "page")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 4, "overlap")] * 2 + [(1, 3, 6, "name")] * 2
    assert "FlatMapCoGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_answers(spark):
    from tamarisk.plans.answering import answers

    corpus = spark.createDataFrame([(1, "the court sits in june\nnothing here"), (2, "fees are ten coins"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "when does the court sit in june"), (2, ""), (3, "should i pay fees"), (4, "zzz")], "query_id long, text string")
    got = {r.query_id: (r.outcome, r.answer) for r in answers(corpus, q).collect()}
    assert got[1][0] == "answered" and "the court sits in june" in got[1][1]
    assert got[2][0] == "requested_info_not_found" and got[3] == ("personalized_legal_advice", None) and got[4] == ("abstained", None)


def test_trees_and_spans(spark):
    from tamarisk.operators.analysis import resolved_span, tree_faults, upload_segments

    n = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("o", "gone")], "node_id string, parent_id string")
    assert {tuple(r) for r in tree_faults(n).collect()} == {("x", "cycle"), ("y", "cycle"), ("o", "orphan")}
    assert resolved_span("aaa", "aa", 1) == (1, 3, "exact") and resolved_span("aaa", "aa")[2] == "ambiguous"
    assert resolved_span("abc", "b", 7) == (1, 2, "corrected") and resolved_span("abc", "z")[2] == "missing"
    t = "word " * 50
    assert all(t[a:b].strip() and b - a <= 60 for a, b in upload_segments(t, 60, 9))
    with pytest.raises(ValueError):
        upload_segments(t, 60, 2)


def test_components_of_chains_and_hubs(spark):
    from tamarisk.operators.graph import components

    edges = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 500 for i in range(500, 540)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deep_trees_and_cycles(spark):
    from tamarisk.operators.analysis import tree_faults

    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(60)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("o", "gone"), ("p", "o")]
    got = {(r.node_id, r.fault) for r in tree_faults(spark.createDataFrame(rows, "node_id string, parent_id string")).collect()}
    assert got == {("o", "orphan")} | {(x, "cycle") for x in "abcds"}


def test_component_split_keeps_components_whole(spark):
    from tamarisk.operators.sampling import component_split

    edges = spark.createDataFrame([(10 * g, 10 * g + i) for g in range(30) for i in range(1, 3 + g % 3)], "a long, b long")
    rows = component_split(edges).collect()
    by = {}
    for r in rows:
        by.setdefault(r.component, set()).add(r.split)
    test = sum(r.split == "test" for r in rows)
    assert all(len(s) == 1 for s in by.values()) and 0.25 * len(rows) <= test <= round(len(rows) / 3)


def test_prefix_sums_against_a_window(spark):
    from pyspark.sql import Window

    from tamarisk.operators.sampling import prefix_sums

    d = spark.range(3000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), F.xxhash64("id").alias("o"), (F.col("id") % 9).alias("v"))
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = {tuple(r) for r in d.select("g", "o", F.coalesce(F.sum("v").over(w), F.lit(0)), F.sum("v").over(Window.partitionBy("g"))).collect()}
    assert {(r.g, r.o, r._before, r._total) for r in prefix_sums(d, ["g"], ["o"], "v").collect()} == want


def test_near_duplicates_by_class_against_brute_force(spark):
    from difflib import SequenceMatcher

    from tamarisk.operators.quality import near_duplicate_texts, text_classes
    from tamarisk.queries.corpus_quality import passages_thrice

    d = passages_thrice(spark, "/root/testdata/sf0.001")
    rows = {r.item_id: r.text for r in d.collect()}
    first = {}
    for k in sorted(rows):
        first.setdefault(rows[k], k)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and SequenceMatcher(None, rows[a], rows[b], autojunk=False).ratio() >= 0.96}
    assert {(r.a, r.b) for r in near_duplicate_texts(d, "item_id", "text").collect()} == want and len(want) >= 30
    assert {r.key: r["class"] for r in text_classes(d, "item_id", "text").collect()} == {k: first[t] for k, t in rows.items()}
    many = spark.createDataFrame([(i, "the same words again and again") for i in range(300)], "k long, t string")
    assert near_duplicate_texts(many, "k", "t").count() == 0


def test_diverse_picks(spark):
    import __spark_entry__ as entry

    got = entry.queries()["diverse_review"](spark, "/root/testdata/sf0.001").collect()
    assert got and max(r.pick for r in got) <= 5 and len({(r.c_nationkey, r.pick) for r in got}) == len(got)


def test_dense_side_of_hybrid_retrieval(spark):
    import numpy as np

    from tamarisk.operators.dense import hashed_encoder
    from tamarisk.plans.answering import dense_ranking, retrieved
    from tamarisk.queries.tables import benchmark, corpus

    sf = "/root/testdata/sf0.001"
    docs, asked = corpus(spark, sf).select("doc_id", "text"), benchmark(spark, sf)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d, q = sorted(docs.collect(), key=lambda r: r.doc_id), sorted(asked.collect(), key=lambda r: r.query_id)
    e = hashed_encoder(64)
    s = unit(e([r.text or "" for r in q])) @ unit(e([r.text or "" for r in d])).T
    got = {}
    for r in dense_ranking(docs, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score))
    for i, r in enumerate(q):
        assert np.allclose([x for _, x in sorted(got[r.query_id])], np.sort(s[i])[::-1][:5], atol=1e-5)
    served = retrieved(docs, asked).collect()
    assert {r.provenance for r in served} <= {"both", "sparse-only", "dense-only"} and max(r.rank for r in served) <= 8


def test_identifiers(spark):
    import uuid

    from tamarisk.operators import identity

    name = "unit|s|v1|p|7|text"
    got = spark.range(1).select(identity.record_id(F.lit("s"), F.lit("v1"), F.lit("p"), F.lit(7), F.lit("text"))).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), name))
    assert identity.fingerprint({"b": 1, "a": "é"}) == identity.fingerprint({"a": "é", "b": 1})
    a, b = spark.createDataFrame([], "x int, y string"), spark.createDataFrame([], "y string, x int")
    assert identity.schema_fingerprint(a) != identity.schema_fingerprint(b)
    assert identity.without_text({"n": 1, "l": [{"m": 2}]}) and pytest.raises(ValueError, identity.without_text, {"l": [{"text": "x"}]})


def test_stores_go_on_where_they_stopped(spark, tmp_path):
    import numpy as np

    from tamarisk.operators.dense import hashed_encoder
    from tamarisk.sources import stores

    calls = f"{tmp_path}/calls"

    def encoder(texts):
        with open(calls, "a") as f:
            f.write("x" * len(texts))
        return hashed_encoder(8)(texts)

    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string")
    path, run = f"{tmp_path}/v", {"model": "m", "dimension": 8}
    assert stores.encode_missing(texts.where("id < 12"), path, run, encoder, 8).count() == 12
    assert stores.store_status(texts, path, run, 8).first().asDict() == {"wanted": 20, "stored": 12, "missing": 8, "stale": 0, "faulty": 0}
    before = len(open(calls).read())
    assert stores.encode_missing(texts, path, run, encoder, 8).count() == 20 and len(open(calls).read()) - before <= 16
    changed = texts.withColumn("text", F.when(F.col("id") == 3, "new").otherwise(F.col("text")))
    assert stores.store_status(changed, path, run, 8).first().stale == 1 and stores.missing_vectors(changed, path, run).count() == 1
    assert stores.missing_vectors(texts, path, {"model": "other"}).count() == 20
    v = {r.id: r.vector for r in stores.encode_missing(changed, path, run, encoder, 8).collect()}
    assert len(v) == 20 and np.allclose(np.linalg.norm(np.array(list(v.values())), axis=1), 1, atol=1e-5)
    done = stores.resumed(texts.where("id < 5"), "id", f"{tmp_path}/r", run, lambda f: f.withColumn("y", F.lit(1)))
    assert done.count() == 5 and stores.resumed(texts, "id", f"{tmp_path}/r", run, lambda f: f.withColumn("y", F.lit(2))).groupBy("y").count().orderBy("y").collect() == [(1, 5), (2, 15)]
    ledger = f"{tmp_path}/once.json"
    assert stores.once(spark, ledger, run, lambda: {"ndcg": 0.5}) == stores.once(spark, ledger, run, lambda: {"ndcg": 0.9}) == {"ndcg": 0.5}
    with pytest.raises(ValueError):
        stores.once(spark, ledger, {"model": "other"}, lambda: {})
    stores.write_report(spark, {"a": {"b": 1.5}}, f"{tmp_path}/m.json")
    assert stores.result_table(spark, f"{tmp_path}/m.json", {"x": "$.a.b"}).first().value == 1.5
    with pytest.raises(Exception, match="no number"):
        stores.result_table(spark, f"{tmp_path}/m.json", {"x": "$.a.c"}).collect()
    views = stores.normalised_views(texts, "id", "text", f"{tmp_path}/views")
    assert views.count() == 60 and {r.policy_id for r in views.select("policy_id").distinct().collect()} == {"raw", "light", "aggressive"}


def test_registry_rules(spark, tmp_path):
    from tamarisk.sources import registry

    columns = [
        "source_id", "decision", "source_role", "jurisdiction", "privacy_risk", "access_status", "file_format", "canonical_url", "licence_status", "permission_evidence_url", "licence_evidence_url", "terms_url",
        "conditions", "required_rights", "manual_action", *registry.PERMISSIONS,
    ]
    good = dict.fromkeys(columns, "") | dict.fromkeys(registry.PERMISSIONS, "yes") | {
        "source_id": "a", "decision": "approved", "source_role": "primary", "privacy_risk": "low", "licence_status": "confirmed", "permission_evidence_url": "https://x.example/p", "terms_url": "https://x.example/t",
    }
    bad = good | {"source_id": "b", "canonical_url": "https://x.example/search?q=1", "derivatives": "conditional", "licence_status": "missing", "permission_evidence_url": ""}
    blocked = dict.fromkeys(columns, "") | {"source_id": "a", "decision": "blocked_pending_review"}
    with open(tmp_path / "r.csv", "w") as f:
        f.write(",".join(columns) + "\n" + "".join(",".join(r[c] for c in columns) + "\n" for r in (good, bad, blocked)))
    rows = registry.registry(spark, f"file://{tmp_path}/r.csv")
    got = {}
    for r in registry.registry_faults(rows).collect():
        got.setdefault(r.source_id, set()).add(r.rule)
    assert got == {"a": {"unique", "blocked_has_an_action"}, "b": {"no_search_urls", "positive_permission_needs_evidence", "open_licence_approves_nothing", "conditions_are_written", "approved_has_a_licence"}}
    assert registry.specifications('[x]\nversion = "1"\nfiles = []')["x"]["version"] == "1"
    with pytest.raises(ValueError):
        registry.specifications('[x]\nversion = "1"')


def test_selection_rules():
    from tamarisk.operators.review import chosen_form, promoted

    assert chosen_form(0.5, 0.503, 0.5, 0.9) == "raw" and chosen_form(0.5, 0.6, 0.5, 0.5) == "light" and chosen_form(0.5, 0.6, 0.5, 0.4) == "raw"
    assert promoted([(0.03, 0.01)], [0.0], 0.02, 0.01) and not promoted([(0.03, -0.01)], [0.0], 0.02, 0.01) and not promoted([(0.03, 0.01)], [-0.02], 0.02, 0.01)


def test_segments_and_anchors(spark):
    from tamarisk.operators.discovery import anchored, segments_of, split_items, strata, unique_anchor

    text = "  First sentence here. Second one؟ third\n\nline "
    got = segments_of(text)
    assert [s for _, _, s in got] == ["First sentence here.", "Second one؟", "third", "line"] and all(text[a:b] == s for a, b, s in got)
    listed = " ['one \\'x\\'', \"two\"] "
    assert [s for _, _, s in segments_of(listed)] == ["one 'x'", "two"] and all(listed[a] in "'\"" for a, _, _ in segments_of(listed))
    assert unique_anchor("a b c", "bc") == ("unique", [2, 4]) and unique_anchor("aXa", "a") == ("ambiguous", []) and unique_anchor("a", "z") == ("missing", []) and unique_anchor("a", " ") == ("empty", [])
    assert unique_anchor("كتـاب", "كتاب") == ("unique", [0, 1, 3, 4])
    rows = spark.createDataFrame([("ab", "b", [[0.0, 0.0, 1.0, 1.0], [1.0, 0.0, 2.0, 3.0]]), ("ab", "b", []), (None, None, None)], "p string, w string, b array<array<double>>")
    assert [tuple(r.anchor) for r in anchored(rows, "p", "w", "b").collect()] == [("unique", 1.0, 0.0, 2.0, 3.0), ("no_geometry", None, None, None, None), ("empty", None, None, None, None)]
    d = spark.createDataFrame([("يجب دفع غرامة", "dev"), ("plain", "holdout"), ("المادة", "dev")], "t string, split string")
    assert [r[0] for r in d.select(strata(F.col("t"))).collect()] == [["normative", "penalty"], ["low_signal"], ["low_signal"]]
    assert split_items(d, "dev").count() == 2 and split_items(d, "holdout", opened=True).count() == 1
    with pytest.raises(PermissionError):
        split_items(d, "holdout")


def test_grids_contexts_and_back_off(spark):
    from tamarisk.operators import experiments as X, metrics
    from tamarisk.queries.evaluation import gold_qrels
    from tamarisk.queries.retrieval import bm25_ranking, jaccard_ranking
    import __spark_entry__ as entry

    sf, q = "/root/testdata/sf0.001", entry.queries()
    grid = {(r.method, r.policy): r for r in q["lexical_grid"](spark, sf).collect()}
    for name, rank in (("bm25", bm25_ranking), ("jaccard", jaccard_ranking)):
        one = metrics.query_metrics(rank(spark, sf, 10), gold_qrels(spark, sf), 10).agg(F.round(F.avg("ndcg"), 8)).first()[0]
        assert grid[name, "raw"].ndcg == grid[name, "light"].ndcg == one
    d = q["candidate_diagnostics"](spark, sf).first()
    assert 0 < d.candidate_recall <= 1 and abs(d.both + d.sparse_only + d.dense_only - 1) < 1e-6
    assert sum(r.hits for r in q["relevant_by_provenance"](spark, sf).collect()) > 0
    rows = q["assembled_context"](spark, sf).collect()
    cost = {(f"{r.conv_id}/{r.turn}"): len(r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for found in by.values():
        left, want = 1500, set()
        for r in sorted(found, key=lambda r: (r["rank"], r.doc_id, r.ordinal, r.unit_id)):
            if cost[r.unit_id] <= left:
                left -= cost[r.unit_id]
                want.add(r.unit_id)
        kept = [r for r in found if r.admitted]
        assert {r.unit_id for r in kept} == want and sorted(r.label for r in kept) == [f"E{i:03d}" for i in range(1, len(kept) + 1)]
        assert len({r.unit_id for r in found}) == len(found) and all(r.label is None for r in found if not r.admitted)
    calls = []

    def encoder(texts):
        calls.append(len(texts))
        if len(texts) > 3:
            raise MemoryError
        return [[float(len(t))] for t in texts]

    assert [x[0] for x in X.backing_off(encoder)(["a" * i for i in range(8)])] == list(range(8)) and max(calls) == 8 and calls.count(2) == 4
    e = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert X.returned_evidence(e, [2]).count() == 1 and X.returned_evidence(e, []).count() == 2
