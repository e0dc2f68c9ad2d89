"""Whether a question may be answered, and what becomes of an answer: ordered rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of questions that the second gate refuses, and roles of a decision's operative part.
LEGAL_TERM = "(?:law|rule|amendment|regulation|statute|text|نظام|قانون|لائحة|تعديل|مادة|قاعدة)"
AHEAD = r"(?:سيصدر|ستصدر|سيطبق|مستقبلاً|في\s+المستقبل|لاحق)"
FUTURE = (
    rf"(?i)(?:future\s+{LEGAL_TERM}|{LEGAL_TERM}\s+.*(?:will\s+be|is\s+going\s+to\s+be)\s+(?:issued|enacted|applied)"
    rf"|what\s+{LEGAL_TERM}.*\bwill\s+be\s+(?:issued|enacted|applied)|if\s+(?:a\s+)?(?:future\s+)?(?:{LEGAL_TERM})\s+(?:is|were)\s+enacted"
    rf"|{AHEAD}\D{{0,30}}{LEGAL_TERM}|{LEGAL_TERM}\D{{0,30}}{AHEAD})"
)
TEMPORAL = (
    r"(?i)(?:changed|change|updated|amended|superseded|remained\s+current|current\s+since|after\s+the\s+judgment|since\s+the\s+judgment"
    r"|تغير|تعدلت|تم\s+تعديل|استبدل|نسخ|بعد\s+تاريخ|منذ\s+تاريخ|بعد\s+الحكم|ساري|نافذ|حالي|الأحدث|آخر\s+نسخة)"
)
AUTHORITATIVE = (
    r"(?i)(?:official|authoritative|statutory\s+text|current\s+regulation|updated\s+provision"
    r"|النص\s+الرسمي|النص\s+النظامي|نص\s+اللائحة|المادة\s+المحدثة|النظام\s+الحالي)"
)
CASE_FACTS = (
    r"(?i)(?:\b(?:was|were|did|has)\b.{0,60}\b(?:established|made|given|paid|served|occurred|act|good\s+faith)\b"
    r"|هل\s+(?:ثبت|كان|تم|وقع|دفع|سلم|أعطي|أعطى|قدم|بلغ|أخطر))"
)
DISPOSITIVE = (
    r"(?i)(?:dispositive|operative|final\s+(?:outcome|ruling|order)|relief\s+(?:granted|denied)|what\s+did\s+the\s+court\s+order"
    r"|منطوق|النتيجة\s+التي\s+تلزم|ماذا\s+قضت|الحكم\s+النهائي|القرار\s+النهائي)"
)
SECTION_MISSING = r"(?i)(?:missing|absent|unavailable|not\s+(?:provided|available|included)|غاب|مفقود|غير\s+(?:متاح|موجود|مرفق)|لا\s+يوجد)"
FORUM = (
    r"(?i)(?:labor\s+court|employment\s+court|commercial\s+court|administrative\s+court|forum|proceeding"
    r"|محكمة\s+عمالية|محكمة\s+تجارية|محكمة\s+إدارية|اختصاص\s+المحكمة)"
)
IDENTIFIED_CASE = r"(?i)(?:judgment\s+[A-Za-z0-9/-]+|case\s+(?:no\.?\s*)?[A-Za-z0-9/-]+|decision\s+[A-Za-z0-9/-]+|في\s+(?:الحكم|القرار|القضية)\s*[0-9]*)"
OPERATIVE_ROLES = ("ruling", "verdict", "disposition", "operative", "holding")
PROVISION_TYPES = ("statute", "regulation", "official")


def scope_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[؀-ۿ]+"), F.lit(0))


def primary_source(role: Column, authority: Column, decision: Column, kind: Column) -> Column:
    """Whether a source is an approved official text of primary law."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("unknown")))
    of_type = low(kind).rlike("|".join(PROVISION_TYPES))
    return low(role).contains("primary") & (low(authority) == "official") & low(decision).isin("approved", "confirmed") & of_type


def second_gate(query: Column, base: Column, primary: Column, roles: Column, scope: Column, status_known: Column, case_facts: Column) -> Column:
    """The reason against an answer once the context is assembled, or null.

    ``base`` is the first gate's reason, consulted last; ``primary``: whether any source of the context is primary law;
    ``roles`` and ``scope``: arrays of the structural roles of its units and of its sources' scope tokens.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    operative = F.arrays_overlap(F.transform(F.coalesce(roles, F.array().cast("array<string>")), F.lower), F.array(*map(F.lit, OPERATIVE_ROLES)))
    in_scope = F.arrays_overlap(scope_tokens(query), F.coalesce(scope, F.array().cast("array<string>")))
    return F.coalesce(
        F.when(query.rlike(FUTURE), "future_law_unknowable")
        .when(query.rlike(AUTHORITATIVE) & ~known(primary), "authoritative_source_unavailable")
        .when(query.rlike(TEMPORAL) & ~known(status_known), "currentness_unverified")
        .when(query.rlike(CASE_FACTS) & ~(known(case_facts) | query.rlike(IDENTIFIED_CASE)), "case_facts_not_established")
        .when(query.rlike(DISPOSITIVE) & (query.rlike(SECTION_MISSING) | ~known(operative)), "required_case_section_missing")
        .when(query.rlike(FORUM) & ~known(in_scope), "forum_or_source_scope_mismatch"),
        base,
    )


def answer_gate(provenance: Column) -> Column:
    """Whether the first hit's provenance lets a demo answer: it must have been found by words."""
    return F.coalesce(provenance.isin("both", "sparse-only"), F.lit(False))


def first_decisive(decision: Column, reason: Column, raw_kind: Column, detail: Column, bad_quotes: Column) -> Column:
    """What decided a run's outcome."""
    text = F.coalesce(detail, F.lit(""))
    says = lambda *words: text.rlike("|".join(words))
    quiet = (decision == "abstain") & reason.isNull()
    return (
        F.when(reason == "currentness_unverified", "pre_generation_currentness_status_policy")
        .when(reason.isin("jurisdiction_mismatch", "jurisdiction_ambiguous"), "pre_generation_jurisdiction_policy")
        .when(reason == "personalized_legal_advice", "pre_generation_personalized_advice_policy")
        .when(reason == "conflicting_evidence", "pre_generation_conflict_policy")
        .when(reason.isin("no_context", "low_retrieval_confidence"), "pre_generation_no_or_insufficient_context")
        .when(reason.isNotNull() & (reason != "invalid_generation"), "other_pre_generation_policy")
        .when((raw_kind == "none") & (decision == "abstain"), "other_pre_generation_policy")
        .when(quiet, "generator_explicitly_returned_abstain")
        .when(says("not valid JSON", "validation error"), "invalid_or_malformed_generator_output")
        .when(says("exact authoritative substring") | F.coalesce(bad_quotes, F.lit(False)), "non_exact_quote")
        .when(says("semantic support"), "semantic_support_diagnostic")
        .when(says("citation", "structural"), "invalid_citation_or_evidence_id")
        .when(decision == "answer", "successful_verified_answer").otherwise("other")
    )


def resolved_quotes(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """``draft_id, claim_no, place, quote_ref, evidence_id, quote, known`` of the quotes that claims refer to by number."""
    r = registry.select("draft_id", "quote_ref", "evidence_id", F.col("text").alias("quote"))
    return refs.join(r, ["draft_id", "quote_ref"], "left").select("draft_id", "claim_no", "place", "quote_ref", "evidence_id", "quote", F.col("evidence_id").isNotNull().alias("known"))


def finalised(drafts: DataFrame, claims: DataFrame, citations: DataFrame, jurisdiction: str | None = None, disclaimer: str = "") -> DataFrame:
    """``draft_id, decision, reason, answer``: what may be shown of each draft.

    ``drafts``: ``draft_id, decision``; ``claims``: ``draft_id, claim_no, mode (direct or interpretation), text, supported``;
    ``citations``: ``draft_id, claim_no, place, evidence_id, quote, source, status`` (checked before). An abstention stays.
    An interpretation without text, a claim without citation, or any citation that isn't valid makes a draft invalid.
    Interpretations stand only where support was found; if no claim is left, the draft abstains. A draft's claims are few.
    """
    said = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.col("quote"), F.lit(" ("), F.col("source"), F.lit(")"))
    cited = citations.groupBy("draft_id", "claim_no").agg(
        F.array_sort(F.collect_list(F.struct("place", said.alias("line")))).alias("lines"), F.bool_and(F.col("status") == "valid").alias("good")
    )
    interpreted = F.col("mode") == "interpretation"
    each = claims.join(cited, ["draft_id", "claim_no"], "left").withColumn("sound", F.coalesce("good", F.lit(False)) & ~(interpreted & F.col("text").isNull()))
    each = each.withColumn("stands", F.col("sound") & (~interpreted | F.coalesce("supported", F.lit(False))))
    lines = F.concat(F.when(interpreted, F.array("text")).otherwise(F.array().cast("array<string>")), F.transform("lines", lambda x: x["line"]))
    of = each.groupBy("draft_id").agg(
        F.bool_and("sound").alias("sound"), F.bool_or("stands").alias("any"), F.array_sort(F.collect_list(F.when(F.col("stands"), F.struct("claim_no", lines.alias("lines"))))).alias("claims")
    )
    out = drafts.join(of, "draft_id", "left")
    head = F.array(*[F.lit(x) for x in ([f"Jurisdiction: {jurisdiction}"] if (jurisdiction or "").strip() else [])]).cast("array<string>")
    tail = F.array(*[F.lit(x) for x in ([disclaimer] if disclaimer.strip() else [])]).cast("array<string>")
    body = F.flatten(F.transform("claims", lambda c: c["lines"]))
    asked = F.col("decision") == "answer"
    reason = F.when(~asked, None).when(~F.coalesce("sound", F.lit(False)), "invalid_generation").when(~F.col("any"), "semantic_support_unavailable")
    ok = asked & reason.isNull()
    answer = F.when(ok, F.array_join(F.concat(head, body, tail), "\n"))
    return out.select("draft_id", F.when(ok, "answer").otherwise("abstain").alias("decision"), reason.alias("reason"), answer.alias("answer"))


def evidence_budget(total: int, fixed: Column, margin: int) -> Column:
    """What is left for evidence beside a prompt's fixed part; null if nothing."""
    left = F.lit(total) - fixed - margin
    return F.when(left > 0, left)


def retention(gold: DataFrame, kept: DataFrame) -> DataFrame:
    """``query_id, gold, retained, share, complete``: how much of each query's wanted units is still there."""
    g = gold.select("query_id", "unit_id").distinct()
    k = kept.select("query_id", "unit_id").distinct().withColumn("there", F.lit(1))
    out = g.join(k, ["query_id", "unit_id"], "left").groupBy("query_id").agg(F.count("*").alias("gold"), F.count("there").alias("retained"))
    return out.withColumn("share", F.round(F.col("retained") / F.col("gold"), 8)).withColumn("complete", F.col("gold") == F.col("retained"))


def rendered_context(units: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``by, context``: a line for each change of document and heading, and ``[label] text`` of each unit.

    ``units`` has ``document, title, heading, label, text``. A query's context is bounded by its budget.
    """
    rows = units.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "document", "title", "heading", "label", "text"))).alias("u"))
    previous = F.concat(F.array(F.lit(None).cast("struct<document:string,heading:string>")), F.transform("u", lambda x: F.struct(x["document"].cast("string").alias("document"), x["heading"].cast("string").alias("heading"))))

    def lines(x: Column, i: Column) -> Column:
        before = F.get(previous, i)
        new = before.isNull() | (before["document"] != x["document"].cast("string"))
        head = new | ~before["heading"].eqNullSafe(x["heading"].cast("string"))
        return F.array_compact(F.array(
            F.when(new, F.concat(F.lit("Document: "), F.coalesce(x["title"], x["document"].cast("string")))),
            F.when(head & (F.coalesce(x["heading"].cast("string"), F.lit("")) != ""), F.concat(F.lit("Heading: "), x["heading"].cast("string"))),
            F.concat(F.lit("["), x["label"], F.lit("] "), x["text"]),
        ))

    return rows.select(by, F.array_join(F.flatten(F.transform("u", lines)), "\n").alias("context"))
