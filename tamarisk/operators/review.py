"""Checks and summaries of evaluation items, reviews, variants and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T

#: Words that betray how an item was made; steps of a review and where each may lead.
IMPLEMENTATION_WORDS = r"(?i)(?:\[intent\s|internal reference|مرجع داخلي|corpus|chunk|qrel|benchmark|gold|evidence|retriev|query[_ -]?id|intent[_ -]?id)"
NEXT_STATES = {
    "draft": ("primary_reviewed",), "primary_reviewed": ("secondary_reviewed", "adjudicated"), "secondary_reviewed": ("adjudicated",),
    "adjudicated": ("frozen",), "frozen": (),
}


def plain(text: Column) -> Column:
    """Lower-cased, everything but words as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_]+", " "))


def validated_items(items: DataFrame, evidence: DataFrame, pii: str) -> DataFrame:
    """One row of counters over ``items(item_id, query, answer, answerable, base)`` and ``evidence(item_id, text, grade)``.

    Repeated base queries (by normal form), empty evidence, answers that don't fit their kind, personal data, lexical overlap of
    half a query's words with its evidence, whole queries inside answer or evidence, and words of the implementation.
    """
    e = evidence.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("text", F.lit("")))), " ").alias("source"), F.max("grade").alias("grade"), F.count("*").alias("spans"))
    rows = items.join(e, "item_id", "left").withColumn("q", plain(F.col("query")))
    has = F.coalesce(F.col("spans") > 0, F.lit(False))
    answered = F.coalesce(F.length("answer") > 0, F.lit(False))
    misfit = F.when(F.col("answerable"), ~(answered & has)).otherwise(answered | has)
    words = F.array_distinct(T.words(F.lower("query")))
    overlap = T.share(F.size(F.array_intersect(words, F.coalesce(T.words(F.lower("source")), F.array().cast("array<string>")))), F.size(words))
    inside = lambda c: F.coalesce(F.contains(plain(F.col(c)), F.col("q")), F.lit(False))
    leak = F.col("answerable") & (F.length("q") >= 12) & (inside("answer") | inside("source"))
    personal = F.coalesce(F.concat_ws("\n", "query", "answer").rlike(pii), F.lit(False))
    out = rows.agg(
        F.count("*").alias("items"), (F.count_if("base") - F.count_distinct(F.when(F.col("base"), F.col("q")))).alias("duplicate_queries"),
        F.count_if(has & (F.coalesce("grade", F.lit(0)) <= 0)).alias("empty_evidence"), F.count_if(misfit).alias("answerability_errors"),
        F.count_if(personal).alias("personal_data"), F.count_if(overlap >= 0.5).alias("lexical_overlap"), F.count_if(leak).alias("direct_leakage"),
        F.count_if(F.col("query").rlike(IMPLEMENTATION_WORDS)).alias("implementation_words"),
    )
    gates = ("duplicate_queries", "empty_evidence", "answerability_errors", "personal_data", "direct_leakage", "implementation_words")
    ok = F.lit(True)
    for g in gates:
        ok &= F.col(g) == 0
    return out.withColumn("valid", ok)


def prefix_only(base: Column, variant: Column) -> Column:
    """Whether a variant is its base behind a non-blank prefix."""
    b, v = T.collapsed(base), T.collapsed(variant)
    return F.coalesce((b != "") & (v != b) & v.endswith(b) & (F.trim(F.left(v, F.length(v) - F.length(b))) != ""), F.lit(False))


def variant_faults(variants: DataFrame) -> DataFrame:
    """``variant_id, dialect, reasons, valid`` of ``variant_id, dialect, text, base_text, intent, qrels`` in order of ``place``."""
    t = T.collapsed(F.coalesce("text", F.lit("")))
    rows = variants.withColumn("_t", t)
    again = F.row_number().over(Window.partitionBy("_t").orderBy("place")) > 1
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\R"), lambda x: F.trim(x) != ""))
    base = T.collapsed(F.coalesce("base_text", F.lit("")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    faults = {
        "empty_text": F.col("_t") == "", "multiple_paraphrases_or_concatenation": lines > 1, "duplicate_variant_text": again, "base_identical": (base != "") & (F.col("_t") == base),
        "prefix_only_rewrite": prefix_only(base, F.col("_t")), "missing_intent_or_qrel_fingerprint": blank("intent") | blank("qrels"),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()])))
    return rows.withColumn("reasons", found).select("variant_id", "dialect", "reasons", (F.size("reasons") == 0).alias("valid"))


def fault_counts(faults: DataFrame) -> DataFrame:
    """``reason, n`` of the rows of ``variant_faults``; a sound row counts as ``valid``."""
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("valid")))
    return faults.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def first_wins(frame: DataFrame, order: list[str], *keys: Column) -> DataFrame:
    """Rows whose keys no earlier row has, key after key; each key sees what the one before it left."""
    for k in keys:
        place = F.row_number().over(Window.partitionBy("_k").orderBy(*order))
        frame = frame.withColumn("_k", k).withColumn("_p", place).where("_p = 1").drop("_k", "_p")
    return frame


def hard_queries(frame: DataFrame, flags: list[str], rank: str, least: int = 20) -> DataFrame:
    """Queries of a hard kind, or whose first relevant hit comes late; each once."""
    hard = F.coalesce(F.col(rank) >= least, F.lit(False))
    for f in flags:
        hard |= F.coalesce(F.col(f).cast("boolean"), F.lit(False))
    return frame.where(hard).dropDuplicates(["query_id"])


def patched(items: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``items`` with the fields that a patch names replaced; ``touched`` tells which rows changed."""
    p = patches.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = items.join(p, F.col(key).eqNullSafe(F.col("_k")), "left")
    changed = F.lit(False)
    for f in fields:
        changed |= F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f))
    put = {f: F.coalesce(f"_{f}", f).alias(f) for f in fields}
    return rows.select(*[put.get(c, F.col(c)) for c in items.columns], changed.alias("touched"))


def stray_patches(items: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Patches of no item, and keys patched twice."""
    twice = patches.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("fault"))
    return patches.join(items, key, "left_anti").select(key, F.lit("unknown").alias("fault")).distinct().unionByName(twice)


def transitions(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``key, from, to, allowed`` of a review's changes of state; staying is allowed."""
    steps = F.create_map(*[x for k, v in NEXT_STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = current.select(key, F.col("state").alias("from")).join(wanted.select(key, F.col("state").alias("to")), key)
    return rows.withColumn("allowed", (F.col("from") == F.col("to")) | F.coalesce(F.array_contains(steps[F.col("from")], F.col("to")), F.lit(False)))


def review_status(items: DataFrame) -> DataFrame:
    """One row of counts by the state of review."""
    state = F.col("state")
    return items.agg(
        F.count("*").alias("items"), F.count_if(state == "draft").alias("draft"), F.count_if(state != "draft").alias("primary_reviewed"),
        F.count_if(state.isin("secondary_reviewed", "adjudicated", "frozen")).alias("secondary_reviewed"), F.count_if("verified").alias("verified"), F.count_if("disagreement").alias("disagreements"),
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    """``outcome, cause, n``: causes are told of confirmed failures only."""
    cause = F.when(F.col("outcome") == "confirmed_failure", F.col("cause"))
    return decisions.groupBy("outcome", cause.alias("cause")).agg(F.count("*").alias("n"))


def agreement(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: confirmed decisions that also have a suggestion, and how many agree."""
    both = cases.where("suggestion is not null").join(decisions.where("outcome = 'confirmed_failure' and cause is not null"), "case_id")
    same = F.col("suggestion") == F.col("cause")
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.round(F.avg(same.cast("double")), 8).alias("rate"))


def retention_audit(wanted: DataFrame, given: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: queries with wanted units among the input, with all of them, and how many keep some or all after assembly.

    Each frame is ``query_id, unit_id``; rates count queries whose input has them.
    """
    flag = lambda frame, name: frame.select("query_id", "unit_id").distinct().withColumn(name, F.lit(1))
    rows = wanted.select("query_id", "unit_id").distinct().join(flag(given, "g"), ["query_id", "unit_id"], "left").join(flag(kept, "k"), ["query_id", "unit_id"], "left")
    q = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count("g").alias("g"), F.count_if(F.col("g").isNotNull() & F.col("k").isNotNull()).alias("k"), F.count("k").alias("all_k"))
    some, whole = F.col("g") > 0, F.col("g") == F.col("n")
    out = q.agg(
        F.count("*").alias("queries"), F.count_if(some).alias("input_some"), F.count_if(whole).alias("input_all"),
        F.count_if(some & (F.col("k") > 0)).alias("kept_some"), F.count_if(whole & (F.col("all_k") == F.col("n"))).alias("kept_all"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 8)).otherwise(0.0)
    return out.withColumn("some_rate", rate("kept_some", "input_some")).withColumn("all_rate", rate("kept_all", "input_all"))


def outcome_metrics(runs: DataFrame) -> DataFrame:
    """``metric, numerator, denominator, value`` of ``population, decision, raw_kind, supported, citations, gold_citations, claims, complete``."""
    answer, abstain = F.col("decision") == "answer", F.col("decision") == "abstain"
    top, absent, no = (F.col("population") == p for p in ("answerable_gold_in_top", "answerable_gold_absent", "unanswerable"))
    n, total = (lambda c: F.count_if(c)), (lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)))
    cited = total(answer, "citations")
    measures = {
        "supported_answer_precision": (n(answer & (F.col("supported") > 0)), n(answer)),
        "supported_answer_coverage": (n(answer & (F.col("supported") > 0)), n(~no)),
        "insufficient_context_abstention": (n(absent & abstain), n(absent)),
        "unanswerable_abstention": (n(no & abstain), n(no)),
        "false_answers": (n(no & answer), n(no)),
        "false_abstentions": (n(top & abstain), n(top)),
        "gold_citation_hits": (total(answer, "gold_citations"), cited),
        "claim_citation_coverage": (total(answer & (F.col("citations") >= F.col("claims")), "claims"), total(answer, "claims")),
        "complete_gold_use": (n(top & F.col("complete")), n(top)),
        "rejected_raw_answers": (n((F.col("raw_kind") == "answer") & abstain), n(F.col("raw_kind") == "answer")),
    }
    row = runs.agg(*[x.cast("long").alias(f"{k}_{i}") for k, pair in measures.items() for i, x in enumerate(pair)])
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_0").alias("numerator"), F.col(f"{k}_1").alias("denominator")) for k in measures])
    out = row.select(F.explode(each).alias("m")).select("m.*")
    return out.withColumn("value", F.when(F.col("denominator") > 0, F.round(F.col("numerator") / F.col("denominator"), 8)).otherwise(0.0))


def confusion(pairs: DataFrame, gold: str, found: str, labels: list[str]) -> DataFrame:
    """One row a gold label with a column for each found one."""
    return pairs.groupBy(gold).pivot(found, labels).agg(F.count(F.lit(1))).fillna(0)


def counts_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, tp, fp, fn, precision, recall, f1`` of summed counts; with no ``by``, one row of micro figures."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    out = rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)
    p, r = (F.when(F.col("tp") + F.col(c) > 0, F.col("tp") / (F.col("tp") + F.col(c))).otherwise(0.0) for c in ("fp", "fn"))
    return out.withColumn("precision", F.round(p, 8)).withColumn("recall", F.round(r, 8)).withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 8))


def error_kinds(rows: DataFrame) -> DataFrame:
    """``kind, n`` of fields' counts: both missed and spurious is a boundary error, counted once; others count each."""
    kind = F.when((F.col("fn") > 0) & (F.col("fp") > 0), "SPAN_BOUNDARY_ERROR").when(F.col("fn") > 0, "MISSED_EXTRACTION").when(F.col("fp") > 0, "SPURIOUS_EXTRACTION")
    n = F.when(kind == "SPAN_BOUNDARY_ERROR", 1).otherwise(F.greatest("fn", "fp"))
    return rows.select(kind.alias("kind"), n.alias("n")).where("kind is not null").groupBy("kind").agg(F.sum("n").alias("n"))


def rule_match(gold: DataFrame, found: DataFrame, by: str, key: list[str]) -> DataFrame:
    """``by, exact, positional``: distinct rules that both sides have over the longer side, and equal modalities by place.

    Both sides have ``place`` and ``modality``.
    """
    same = gold.select(by, *key).distinct().intersect(found.select(by, *key).distinct()).groupBy(by).agg(F.count("*").alias("same"))
    n, m = gold.groupBy(by).agg(F.count("*").alias("n")), found.groupBy(by).agg(F.count("*").alias("m"))
    pairs = gold.select(by, "place", F.col("modality").alias("x")).join(found.select(by, "place", F.col("modality").alias("y")), [by, "place"])
    at = pairs.groupBy(by).agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("positional"))
    out = n.join(m, by, "full_outer").join(same, by, "left").join(at, by, "left").fillna(0, ["n", "m", "same"]).fillna(0.0, ["positional"])
    return out.select(by, F.round(F.col("same") / F.greatest("n", "m", F.lit(1)), 8).alias("exact"), F.round("positional", 8).alias("positional"))


def positional_accuracy(gold: Column, found: Column) -> Column:
    """The share of gold's places that found has equal; 0 of nothing."""
    hits = F.size(F.filter(F.zip_with(gold, found, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    return F.round(hits / F.greatest(F.size(gold), F.lit(1)), 8)


def set_prf(gold: Column, found: Column) -> Column:
    """A struct of precision, recall and f1 of two arrays as sets; nothing found where nothing is wanted is precise."""
    g, f = F.array_distinct(gold), F.array_distinct(found)
    tp = F.size(F.array_intersect(g, f))
    p = F.when(F.size(f) > 0, tp / F.size(f)).when(F.size(g) == 0, 1.0).otherwise(0.0)
    r = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(1.0)
    return F.struct(F.round(p, 8).alias("precision"), F.round(r, 8).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 8).alias("f1"))


def counterfactual(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: the rates without and with a check, the absolute and the relative reduction, and pairs that changed."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = pairs.agg(F.count("*").alias("n"), rate(before).alias("b"), rate(after).alias("a"), F.count_if(F.col(before) != F.col(after)).alias("discordant"))
    return out.select(
        "n", F.round("b", 8).alias("pre"), F.round("a", 8).alias("post"), F.round(F.col("b") - F.col("a"), 8).alias("absolute_reduction"),
        F.when(F.col("b") > 0, F.round((F.col("b") - F.col("a")) / F.col("b"), 8)).alias("relative_reduction"), "discordant",
    )


def rerank_gate(metrics: DataFrame, base: str, other: str, gain: float = 0.002, loss: float = 0.01) -> DataFrame:
    """One row of ``system, ndcg, recall, complete``: whether the other system's gain outweighs what it may lose."""
    of = lambda s: metrics.where(F.col("system") == s).select(*[F.col(c).alias(f"{c}_{'x' if s == base else 'y'}") for c in ("ndcg", "recall", "complete")])
    d = of(base).crossJoin(of(other)).select(*[F.round(F.col(f"{c}_y") - F.col(f"{c}_x"), 8).alias(f"{c}_delta") for c in ("ndcg", "recall", "complete")])
    ok = (F.col("ndcg_delta") >= gain) & (F.col("recall_delta") >= -loss) & (F.col("complete_delta") >= -loss)
    return d.withColumn("eligible", ok).withColumn("selected", F.when(ok, F.lit(other)).otherwise(F.lit(base)))


def chosen_form(raw_ndcg: float, light_ndcg: float, raw_recall: float, light_recall: float, near: float = 0.005, loss: float = 0.02) -> str:
    """Which of two normal forms to keep: the simpler one if they are close, else the better one unless it loses much recall."""
    if abs(raw_ndcg - light_ndcg) < near:
        return "raw"
    better, other = ("raw", "light") if raw_ndcg > light_ndcg else ("light", "raw")
    recall = {"raw": raw_recall, "light": light_recall}
    return other if recall[better] < recall[other] - loss else better


def promoted(gains: list[tuple[float, float]], guards: list[float], least: float, tolerance: float) -> bool:
    """Whether a more destructive form is worth it: one (gain, lower bound) is large and sure, and no guard falls by much."""
    return any(gain >= least and low > 0 for gain, low in gains) and all(g >= -tolerance for g in guards)


def sensitivity_class(phenomenon: Column, expected: Column, raw_preserves: Column, repaired: Column, score_changed: Column, rank_changed: Column) -> Column:
    """What a disturbed query shows of a normal form."""
    defect = "harness_or_perturbation_defect"
    return (
        F.when(phenomenon == "unchanged_control", "unchanged_control").when(~expected, defect).when(~raw_preserves, "redundant_or_tokenizer_insensitive")
        .when(~repaired, defect).when(rank_changed, "rank_or_top10_change").when(score_changed, "score_change_no_rank_change").otherwise(defect)
    )


def run_summary(scores: DataFrame, system: str, value: str, base: str) -> DataFrame:
    """``system, metric, n, mean, delta``: each system's mean of each metric and its difference from a base system's."""
    means = scores.groupBy(system, "metric").agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    b = means.where(F.col(system) == base).select("metric", F.col("m").alias("b"))
    return means.join(b, "metric", "left").select(system, "metric", "n", F.round("m", 8).alias("mean"), F.round(F.col("m") - F.col("b"), 8).alias("delta"))


def source_gaps(targets: DataFrame, known: DataFrame, target: str, law: str) -> DataFrame:
    """``target, status, need``: targets whose law (``law``, null if none is named) is known, and what the others need."""
    k = known.select(F.col("law").alias("_law"), F.col("status").alias("_status"))
    rows = targets.join(k, F.col(law) == F.col("_law"), "left")
    there = F.coalesce(F.col("_status") != "", F.lit(False))
    need = F.when(F.col(law).isNotNull(), "authoritative_article_count_and_manual_samples").otherwise("official_machine_readable_source_or_manual_authority_record")
    return rows.select(target, F.when(there, "present_untrusted").otherwise("missing_targeted_acquisition").alias("status"), need.alias("need"))


def page_references(text: Column) -> Column:
    """The numbers behind a word for page."""
    return F.regexp_extract_all(text, F.lit(r"(?:صفحة|ص)\s*([0-9٠-٩]+)"), F.lit(1))


def rare_windows(docs: DataFrame, key: str, text: str, widths: range = range(2, 9)) -> DataFrame:
    """``key, start, width, rarity, window`` of each text's rarest run of tokens: greatest sum of 1 / corpus frequency over words,
    then most words, then first.

    Windows are taken around five evenly spread tokens, so a text brings at most five a width.
    """
    toks = docs.select(F.col(key).alias("key"), T.tokens(F.col(text)).alias("t")).where(F.size("t") >= min(widths))
    words = toks.select("key", F.posexplode("t").alias("at", "w"))
    df = words.where(F.col("w").rlike(r"(?U)[\p{L}\p{N}]")).groupBy("w").agg(F.count("*").alias("f"))
    scored = words.join(df, "w", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", (1 / F.col("f")).alias("r"), F.col("w").alias("w")))).alias("t"))
    n = F.size("t")
    places = F.array_distinct(F.array(F.lit(0), F.expr("int(size(t) div 4)"), F.expr("int(size(t) div 2)"), F.expr("int(3 * size(t) div 4)"), n - 1))
    rows = scored.select("key", "t", F.explode(places).alias("p")).select("key", "t", "p", F.explode(F.array(*map(F.lit, widths))).alias("width")).where("width <= size(t)")
    rows = rows.withColumn("start", F.greatest(F.lit(0), F.least(F.expr("int(p - width div 2)"), n - F.col("width")))).select("key", "start", "width", F.slice("t", F.col("start") + 1, F.col("width")).alias("s"))
    rarity = F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.coalesce(x["r"], F.lit(0.0))), 10)
    rows = rows.select("key", "start", "width", rarity.alias("rarity"), F.size(F.filter("s", lambda x: x["r"].isNotNull())).alias("words"), F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("window"))
    best = F.max(F.struct("rarity", "words", (-F.col("start")).alias("first"), "width", "window")).alias("b")
    return rows.groupBy("key").agg(best).select("key", (-F.col("b.first")).alias("start"), "b.width", "b.rarity", "b.window")
