"""Evidence in units of text: segments, opportunities, pairs and triples, selections for annotation, anchors on pages."""

from __future__ import annotations

import ast
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T

#: Cues of what a unit may say, for drawing samples of all kinds.
STRATA = {
    "normative": "يجب|يلتزم|يحظر|لا يجوز|يجوز|يتعين", "exception": "إلا|باستثناء|ما لم|على الرغم", "penalty": "غرامة|يعاقب|جزاء|عقوبة",
    "temporal": r"[0-9٠-٩]|يوم|شهر|سنة|تاريخ", "money_percentage": "ريال|SAR|٪|%", "reference": "المادة|نظام|لائحة",
}
#: What a segment must have to say anything.
LEAST_LENGTH, LEAST_LETTERS = 24, 8

_QUOTED = re.compile(r"(['\"])(?:\\.|(?!\1).)*\1")
_BREAK = re.compile(r"(?<=[.!?؟؛:])\s+|\n+")


def segments_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of a text's sentences and lines, or of the items where the text is a list literal."""
    inner = text.strip()
    if inner.startswith("[") and inner.endswith("]"):
        out, shift = [], len(text) - len(text.lstrip())
        for m in _QUOTED.finditer(inner):
            try:
                value = ast.literal_eval(m.group())
            except (SyntaxError, ValueError):
                continue
            out.append((shift + m.start(), shift + m.end(), value))
        if out:
            return out
    out, at = [], 0
    for cut in [*[(m.start(), m.end()) for m in _BREAK.finditer(text)], (len(text), len(text))]:
        piece = text[at : cut[0]]
        start = at + len(piece) - len(piece.lstrip())
        if piece.strip():
            out.append((start, start + len(piece.strip()), piece.strip()))
        at = cut[1]
    return out


def segments(units: DataFrame, text: str = "text") -> DataFrame:
    """Each unit's segments that say something, with ``start, end, segment`` in place of its text."""

    @F.arrow_udf("array<struct<start:int,end:int,segment:string>>")
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("segment", pa.string())]))
        return pa.array([[{"start": a, "end": b, "segment": s} for a, b, s in segments_of(t or "")] for t in texts.to_pylist()], kind)

    rows = units.withColumn("s", F.explode(find(text))).drop(text).select("*", "s.*").drop("s")
    return rows.where((F.length("segment") >= LEAST_LENGTH) & (F.regexp_count("segment", F.lit(r"\p{L}")) >= LEAST_LETTERS))


def opportunities(found: DataFrame, categories: dict[str, dict[str, str]], by: str = "unit_id") -> DataFrame:
    """``found`` with a row for each category a segment fits, ``score`` and its ``place`` among its unit's, best first.

    A category has a ``cue``, and maybe ``also`` (another pattern to be met) and ``types`` (joined by bars, of ``unit_type``).
    Cues weigh most, then length.
    """
    each = []
    for name, c in categories.items():
        fits = F.col("segment").rlike(c["cue"])
        if "also" in c:
            fits &= F.col("segment").rlike(c["also"])
        if "types" in c:
            fits &= F.col("unit_type").isin(*c["types"].split("|"))
        n = F.length("segment")
        score = 100 * F.regexp_count("segment", F.lit(c["cue"])) + F.least(n, F.lit(900)) + F.least(F.floor(n / 8).cast("int"), F.lit(80))
        each.append(F.when(fits, F.struct(F.lit(name).alias("category"), score.alias("score"))))
    rows = found.withColumn("c", F.explode(F.array_compact(F.array(*each)))).select("*", "c.*").drop("c")
    order = Window.partitionBy(by, "category").orderBy(F.desc("score"), "start", "end")
    return rows.withColumn("place", F.row_number().over(order))


def paired_evidence(units: DataFrame, document: str, kind: str, order: list[str]) -> DataFrame:
    """``document, first, second`` (structs of order and kind): a document's first unit and the next one of another kind."""
    key = F.struct(*order, kind)
    first = units.groupBy(F.col(document).alias("_d")).agg(F.min(key).alias("first"))
    rest = units.join(first, F.col(document).eqNullSafe(F.col("_d"))).where((F.col(kind) != F.col(f"first.{kind}")) & (key > F.col("first")))
    return rest.groupBy(document, "first").agg(F.min(key).alias("second")).select(document, "first", "second")


def long_words(text: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(T.words(F.lower(text)), lambda w: F.length(w) >= least))


def linked_triples(premises: DataFrame, reasons: DataFrame, conclusions: DataFrame, document: str, most: tuple[int, int, int] = (24, 24, 16)) -> DataFrame:
    """``document, a, b, c``: of each document the first premise, reason and conclusion of which every two share a long word.

    Each side is ``document, place, text``; only its first places (``most``: what a reader looks through) are tried, so a
    document brings a bounded number of pairs.
    """
    def side(frame: DataFrame, name: str, n: int) -> DataFrame:
        w = Window.partitionBy(document).orderBy("place")
        rows = frame.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n)
        return rows.select(document, F.col("place").alias(name), long_words(F.col("text")).alias(f"{name}_w"))

    a, b, c = side(premises, "a", most[0]).where("size(a_w) >= 2"), side(reasons, "b", most[1]), side(conclusions, "c", most[2])
    pairs = a.join(b, document).where(F.arrays_overlap("a_w", "b_w"))
    triples = pairs.join(c, document).where(F.arrays_overlap("a_w", "c_w") & F.arrays_overlap("b_w", "c_w"))
    return triples.groupBy(document).agg(F.min(F.struct("a", "b", "c")).alias("t")).select(document, "t.*")


def strata(text: Column) -> Column:
    """The kinds of cues a text has; references don't count alone, and a text without any is of low signal."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in sorted(STRATA.items())]))
    telling = F.array_remove(found, "reference")
    with_reference = F.when(F.array_contains(found, "reference"), F.concat(telling, F.array(F.lit("reference")))).otherwise(telling)
    return F.when(F.size(telling) > 0, with_reference).otherwise(F.array(F.lit("low_signal")))


def annotation_selection(units: DataFrame, seed: str, holdout: int = 40, dev: int = 80) -> DataFrame:
    """``unit_id, document_id, split, strata``: a sampling operator over units of distinct text, in seeded hash order.

    The holdout takes one unit a document, one of low signal first; dev takes units of other documents, again one of low
    signal first.
    """
    rows = units.select("unit_id", "document_id", F.sha2("text", 256).alias("h"), strata(F.col("text")).alias("strata"))
    first = rows.groupBy("h").agg(F.min("unit_id").alias("unit_id"))
    rows = rows.join(first, ["h", "unit_id"]).withColumn("rank", F.sha2(F.concat_ws(":", F.lit(seed), F.col("unit_id").cast("string")), 256))
    low = F.col("strata")[0] == "low_signal"
    one = F.struct("rank", "unit_id", "document_id", "strata")

    def drawn(frame: DataFrame, n: int, split: str, per_document: bool) -> DataFrame:
        lead = frame.where(low).orderBy("rank").limit(1).withColumn("lead", F.lit(0))
        key = "document_id" if per_document else "unit_id"
        rest = frame.join(lead.select(key), key, "left_anti")
        if per_document:
            rest = rest.groupBy("document_id").agg(F.min(one).alias("o")).select("o.*")
        both = lead.select("rank", "unit_id", "document_id", "strata", "lead").unionByName(rest.select("rank", "unit_id", "document_id", "strata").withColumn("lead", F.lit(1)))
        return both.orderBy("lead", "rank").limit(n).select("unit_id", "document_id", F.lit(split).alias("split"), "strata")

    held = drawn(rows, holdout, "holdout", True)
    return held.unionByName(drawn(rows.join(held.select("document_id"), "document_id", "left_anti"), dev, "dev", False))


def split_items(items: DataFrame, split: str, opened: bool = False) -> DataFrame:
    """Items of one split; the holdout is given out only on purpose."""
    if split == "holdout" and not opened:
        raise PermissionError("the holdout is opened only for a final evaluation")
    return items.where(F.col("split") == split)


def span_qrels(evidence: DataFrame, chunk_spans: DataFrame) -> DataFrame:
    """``query_id, chunk_id, grade``: chunks that overlap a graded span of evidence, by their greatest grade above 0."""
    e = evidence.select("query_id", "unit_id", F.col("start").alias("s"), F.col("end").alias("e"), "grade")
    rows = e.join(chunk_spans, "unit_id").where("s < end and start < e")
    return rows.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade")).where("grade > 0")


def metadata_fields(raw: Column, fields: list[str]) -> list[Column]:
    """Fields of a JSON object as trimmed text; null where the JSON or the field is bad or blank."""
    return [F.nullif(F.trim(F.get_json_object(raw, f"$.{f}")), F.lit("")).alias(f) for f in fields]


def eligible(rows: DataFrame, kinds: tuple[str, ...] = ("article", "article_fragment")) -> DataFrame:
    """Statutory units of primary sources that may be used locally."""
    low = lambda c: F.lower(F.col(c))
    ok = (low("jurisdiction") == "saudi_arabia") & (low("source_role") == "primary_corpus") & (low("source_type") == "dataset")
    return rows.where(ok & low("decision").isin("approved", "conditional", "local_research_only") & low("unit_type").isin(*kinds))


def served_rankings(rankings: DataFrame, status: DataFrame, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """Ranks 1 to ``depth`` of the queries that completed with as many distinct documents, and ``query_id, fault`` of the others."""
    top = rankings.where(F.col("rank") <= depth)
    each = top.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"))
    q = status.join(each, "query_id", "left").fillna(0, ["n", "d"])
    fault = F.when(F.col("status") != "completed", "not_completed").when(F.col("n") < depth, "too_few").when(F.col("d") < F.col("n"), "repeated")
    q = q.withColumn("fault", fault)
    return top.join(q.where("fault is null").select("query_id"), "query_id", "left_semi"), q.where("fault is not null").select("query_id", "fault")


def failure_phase(error: Column, received: Column) -> Column:
    """What went wrong in a call, by the class of its error."""
    return (
        F.when(error.isin("TimeoutError", "timeout"), F.when(received, "read_timeout").otherwise("overall_timeout")).when(error == "HTTPError", "http_error")
        .when(error.isin("URLError", "ConnectionError", "ConnectionResetError", "ConnectionRefusedError"), "connection_error")
        .when(error.isin("JSONDecodeError", "ValueError"), "malformed_response").otherwise("other")
    )


def distribution(frame: DataFrame, by: list[str], column: str) -> DataFrame:
    """``by, count, p50, p95, max``; percentiles are interpolated."""
    p = lambda x: F.round(F.percentile(column, x), 8)
    return frame.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(column).alias("max"))


def variant_matrix(scores: DataFrame) -> DataFrame:
    """``system, dialect, n, base, variant, delta`` of ``system, intent, dialect (null: the base), value``."""
    base = scores.where("dialect is null").select("system", "intent", F.col("value").alias("b"))
    rows = scores.where("dialect is not null").join(base, ["system", "intent"])
    return rows.groupBy("system", "dialect").agg(F.count("*").alias("n"), F.round(F.avg("b"), 8).alias("base"), F.round(F.avg("value"), 8).alias("variant"), F.round(F.avg(F.col("value") - F.col("b")), 8).alias("delta"))


def failure_taxonomy(records: DataFrame) -> DataFrame:
    """``kind, n`` of ``gold_rules, found_rules (null: no result), same_candidates, duplicates, wrong_modality, wrong_actor``."""
    failed = F.col("found_rules").isNull()
    gap = F.col("gold_rules") - F.col("found_rules")
    kinds = {
        "PIPELINE_FAILURE": F.when(failed, 1), "MISSED_EXTRACTION": F.when(~failed, F.greatest(gap, F.lit(0))), "SPURIOUS_EXTRACTION": F.when(~failed, F.greatest(-gap, F.lit(0))),
        "WRONG_CANDIDATE_CLASSIFICATION": F.when(~failed & ~F.col("same_candidates"), 1), "DUPLICATE_EXTRACTION": F.when(~failed, F.col("duplicates")),
        "WRONG_MODALITY": F.when(~failed, F.col("wrong_modality")), "WRONG_ACTOR_ACTION_ASSOCIATION": F.when(~failed, F.col("wrong_actor")),
    }
    row = records.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in kinds.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


def first_of_each(frame: DataFrame, key: str, predicates: dict[str, Column]) -> DataFrame:
    """``kind, key``: the least key that each predicate holds for; null if for none."""
    row = frame.agg(*[F.min(F.when(p, F.col(key))).alias(k) for k, p in predicates.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias(key)) for k in predicates])).alias("x")).select("x.*")


def locator(text: str) -> tuple[str, list[int]]:
    """A text without white space and tatweel in compatibility form, and which character each of its characters came from."""
    out, places = [], []
    for i, c in enumerate(text):
        form = "" if c.isspace() else unicodedata.normalize("NFKC", c).replace("ـ", "")
        out.append(form)
        places += [i] * len(form)
    return "".join(out), places


def unique_anchor(page: str, wanted: str) -> tuple[str, list[int]]:
    """(status, characters) of a wanted text on a page: unique, missing, ambiguous or empty; overlapping places count."""
    plain, places = locator(page)
    target, _ = locator(wanted)
    if not target:
        return "empty", []
    starts = [m.start() for m in re.finditer(f"(?={re.escape(target)})", plain)]
    if len(starts) != 1:
        return ("ambiguous" if starts else "missing"), []
    return "unique", places[starts[0] : starts[0] + len(target)]


def anchored(rows: DataFrame, page: str, wanted: str, boxes: str) -> DataFrame:
    """``rows`` with ``anchor``: status and, of a unique place, the smallest box around its characters' ``boxes`` (x0, y0, x1, y1 each)."""

    @F.arrow_udf("struct<status:string,x0:double,y0:double,x1:double,y1:double>")
    def find(pages: pa.Array, texts: pa.Array, all_boxes: pa.Array) -> pa.Array:
        out = []
        for p, w, b in zip(pages.to_pylist(), texts.to_pylist(), all_boxes.to_pylist()):
            status, at = unique_anchor(p or "", w or "")
            if status == "unique" and len(b or []) != len(p):
                status, at = "no_geometry", []
            of = [b[i] for i in at]
            out.append({"status": status, **{k: f(x[i] for x in of) if of else None for i, (k, f) in enumerate((("x0", min), ("y0", min), ("x1", max), ("y1", max)))}})
        return pa.array(out, pa.struct([("status", pa.string()), *[(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]]))

    return rows.withColumn("anchor", find(page, wanted, boxes))
