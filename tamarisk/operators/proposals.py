"""Proposed extractions held against their source: spans must stand in the text, references among the known candidates, and what doesn't is dropped with its reason.

A proposal is a JSON object that quotes its source and never gives offsets: ``regulated_entities``, ``exceptions`` and ``penalties`` are lists of quotes (``text``,
``occurrence``), ``rules`` have a ``modality``, an ``action`` and perhaps an ``actor``, ``conditions`` and ``exceptions``, all quotes, and everywhere lists of candidates' labels
(``deadline_refs`` and the like) say which known values are meant. Each quote and each label becomes a row; quotes are looked up in their text and labels joined with the
candidates, so an item of any size is rows like all others.

A quote that stands once is where it stands, whatever occurrence it claims; one that stands more often (also overlapping itself) needs a valid occurrence, counted from 0. A rule
without a place for its action is dropped whole, its other parts unexamined. Items without candidates at all (no registry) have nothing accepted. An object that
isn't one, or has other keys than these, is no proposal: its item keeps what was known without it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's keys, the kinds of candidate that each list of labels may name, and the order of rules by modality.
QUOTES = ("regulated_entities", "exceptions", "penalties")
REFERENCES = {"deadline_refs": "temporal", "effective_date_refs": "temporal", "monetary_threshold_refs": "monetary", "percentage_threshold_refs": "percentage"}
RULE_REFERENCES = ("deadline_refs", "monetary_threshold_refs", "percentage_threshold_refs")
RULE_KEYS = ("modality", "action", "actor", "conditions", "exceptions", *REFERENCES)
QUOTE_KEYS = ("text", "occurrence")
MODALITIES = ("obligation", "prohibition", "permission")

_QUOTE = "map<string,string>"
_RULE = f"struct<modality:string,action:{_QUOTE},actor:{_QUOTE},conditions:array<{_QUOTE}>,exceptions:array<{_QUOTE}>," + ",".join(f"{r}:array<string>" for r in REFERENCES) + ">"
_PROPOSAL = "struct<" + ",".join([*(f"{q}:array<{_QUOTE}>" for q in QUOTES), *(f"{r}:array<string>" for r in REFERENCES), f"rules:array<{_RULE}>"]) + ">"


def _only(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.forall(keys, lambda k: k.isin(*allowed))


def parsed(proposals: DataFrame) -> DataFrame:
    """``item_id, p`` (null where ``raw`` isn't a proposal) of ``item_id, raw``."""
    top = F.from_json("raw", "map<string,string>")
    p = F.from_json("raw", _PROPOSAL)
    rules = F.from_json(top["rules"], "array<map<string,string>>")
    none = F.array().cast(f"array<{_QUOTE}>")
    quotes = F.concat(*[F.coalesce(F.col(f"p.{q}"), none) for q in QUOTES], F.flatten(F.transform(F.coalesce("p.rules", F.array().cast(f"array<{_RULE}>")), lambda r: F.concat(
        F.array_compact(F.array(r["action"], r["actor"])), F.coalesce(r["conditions"], none), F.coalesce(r["exceptions"], none)))))
    rows = proposals.select("item_id", "raw", top.alias("top"), p.alias("p"), rules.alias("r"))
    right = (
        F.col("top").isNotNull() & _only(F.map_keys("top"), (*QUOTES, *REFERENCES, "rules", "schema_version"))
        & F.forall(F.coalesce("r", F.array().cast("array<map<string,string>>")), lambda m: _only(F.map_keys(m), RULE_KEYS) & F.map_contains_key(m, "modality") & F.map_contains_key(m, "action"))
        & F.forall(quotes, lambda q: _only(F.map_keys(q), QUOTE_KEYS) & F.map_contains_key(q, "text"))
        & (F.col("top")["rules"].isNull() | F.col("r").isNotNull())
    )
    return rows.select("item_id", F.when(F.coalesce(right, F.lit(False)), F.col("p")).alias("p"))


def _rows(field: Column, rule: Column, part: str, values: Column) -> Column:
    """Structs of a list of quotes, in order."""
    empty = F.array().cast(f"array<{_QUOTE}>")
    return F.transform(F.coalesce(values, empty), lambda q, i: F.struct(field.alias("field"), rule.cast("int").alias("rule"), F.lit(part).alias("part"), i.alias("place"), q["text"].alias("text"), q["occurrence"].cast("int").alias("occurrence")))


def quotes(found: DataFrame) -> DataFrame:
    """``item_id, field, rule, part, place, text, occurrence``: a row a quote; ``rule`` is null outside rules."""
    nothing = F.lit(None)
    outside = F.concat(*[_rows(F.lit(q), nothing, q, F.col(f"p.{q}")) for q in QUOTES])
    one = lambda q: F.array_compact(F.array(q))

    def of_rule(r: Column, i: Column) -> Column:
        at = lambda part: F.concat(F.lit("rules["), i.cast("string"), F.lit(f"].{part}"))
        return F.concat(_rows(at("action"), i, "action", one(r["action"])), _rows(at("actor"), i, "actor", one(r["actor"])),
                        _rows(at("conditions"), i, "conditions", r["conditions"]), _rows(at("exceptions"), i, "exceptions", r["exceptions"]))

    inside = F.flatten(F.transform(F.coalesce("p.rules", F.array().cast(f"array<{_RULE}>")), of_rule))
    return found.where("p is not null").select("item_id", F.explode(F.concat(outside, inside)).alias("q")).select("item_id", "q.*")


def references(found: DataFrame) -> DataFrame:
    """``item_id, field, rule, part, place, label, expected``: a row a label."""
    empty = F.array().cast("array<string>")

    def rows(field: Column, rule: Column, part: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, empty), lambda v, i: F.struct(field.alias("field"), rule.cast("int").alias("rule"), F.lit(part).alias("part"), i.alias("place"), v.alias("label"), F.lit(REFERENCES[part]).alias("expected")))

    outside = F.concat(*[rows(F.lit(r), F.lit(None), r, F.col(f"p.{r}")) for r in REFERENCES])
    inside = F.flatten(F.transform(F.coalesce("p.rules", F.array().cast(f"array<{_RULE}>")), lambda r, i: F.concat(
        *[rows(F.concat(F.lit("rules["), i.cast("string"), F.lit(f"].{x}")), i, x, r[x]) for x in RULE_REFERENCES])))
    return found.where("p is not null").select("item_id", F.explode(F.concat(outside, inside)).alias("q")).select("item_id", "q.*")


def places(text: Column, quote: Column) -> Column:
    """The offsets at which a quote stands in a text, overlapping ones too: the text is cut before each, and cuts add up."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.when(F.startswith(x, F.left(quote, F.length(x))) & F.startswith(F.substring(text, a["at"] + 1, F.length(quote)), quote), F.array_append(a["found"], a["at"])).otherwise(a["found"]).alias("found"))
    return F.when(quote == "", F.array().cast("array<int>")).otherwise(F.aggregate(F.split(text, quoted), start, step)["found"])


def resolved_quotes(rows: DataFrame, units: DataFrame, known: DataFrame) -> DataFrame:
    """The quotes with ``start``, ``end`` (null if dropped), ``code`` and ``accepted``; ``units`` is ``item_id, text``, ``known`` has the items with a registry."""
    rows = rows.join(units.select("item_id", F.col("text").alias("_source")), "item_id", "left").join(known.select("item_id", F.lit(True).alias("_known")).distinct(), "item_id", "left")
    rows = rows.withColumn("_at", places(F.coalesce("_source", F.lit("")), F.coalesce("text", F.lit(""))))
    n, which = F.size("_at"), F.col("occurrence")
    code = (
        F.when(F.col("_known").isNull(), "MISSING_REGISTRY").when(n == 0, "UNSUPPORTED_MODEL_SPAN")
        .when((n == 1) & (F.coalesce(which, F.lit(0)) != 0), "INVALID_OCCURRENCE_CORRECTED")
        .when((n > 1) & (which.isNull() | (which < 0) | (which >= n)), "AMBIGUOUS_OR_INVALID_OCCURRENCE")
    )
    rows = rows.withColumn("code", code).withColumn("accepted", F.col("code").isNull() | (F.col("code") == "INVALID_OCCURRENCE_CORRECTED"))
    start = F.when(F.col("accepted"), F.get("_at", F.when(n == 1, F.lit(0)).otherwise(which)))
    return rows.withColumn("start", start).withColumn("end", start + F.length("text")).drop("_source", "_known", "_at")


def resolved_references(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The labels with ``code`` and ``accepted``; ``candidates`` is ``item_id, label, kind``."""
    there = candidates.select("item_id").distinct().withColumn("_known", F.lit(True))
    same = candidates.select("item_id", "label", F.col("kind").alias("_kind")).distinct()
    rows = rows.join(there, "item_id", "left").join(same, ["item_id", "label"], "left")
    code = F.when(F.col("_known").isNull(), "MISSING_REGISTRY").when(~F.col("_kind").eqNullSafe(F.col("expected")), "INVALID_CANDIDATE_REFERENCE")
    return rows.withColumn("code", code).withColumn("accepted", F.col("code").isNull()).drop("_known", "_kind")


def assembled(units: DataFrame, candidates: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """``quotes`` and ``references`` that stand, ``rules`` (with ``modality`` and ``position`` among an item's rules) and ``diagnostics`` (``item_id, field, place, code, accepted``)."""
    found = parsed(proposals)
    rules = found.where("p is not null").select("item_id", F.posexplode("p.rules").alias("rule", "r")).select("item_id", "rule", F.lower("r.modality").alias("modality"))
    said = resolved_quotes(quotes(found), units, candidates)
    named = resolved_references(references(found), candidates)
    standing = said.where("part = 'action' and accepted").select("item_id", "rule").distinct()
    # what belongs to a rule counts only if its action stands
    looked = lambda rows: rows.where("rule is null or part = 'action'").unionByName(rows.where("rule is not null and part != 'action'").join(standing, ["item_id", "rule"], "left_semi"))
    said, named = looked(said), looked(named)
    broken = found.where("p is null").select("item_id", F.lit("provider").alias("field"), F.lit(0).alias("place"), F.lit("INVALID_PROVIDER_JSON").alias("code"), F.lit(False).alias("accepted"))
    notes = [x.where("code is not null").select("item_id", "field", "place", "code", "accepted") for x in (said, named)]
    order = reduce(lambda c, m: c.when(F.col("modality") == m, MODALITIES.index(m)), MODALITIES[1:], F.when(F.col("modality") == MODALITIES[0], 0))
    kept = rules.where(F.col("modality").isin(*MODALITIES)).join(standing, ["item_id", "rule"], "left_semi").withColumn("_order", order)
    before = F.array_sort(F.collect_list(F.struct("_order", "rule", "modality")))
    kept = kept.groupBy("item_id").agg(before.alias("all")).select("item_id", F.posexplode("all").alias("position", "r")).select("item_id", F.col("r.rule").alias("rule"), F.col("r.modality").alias("modality"), "position")
    return {
        "quotes": said.where("accepted").drop("code", "accepted", "occurrence"), "references": named.where("accepted").drop("code", "accepted", "expected"),
        "rules": kept, "diagnostics": reduce(DataFrame.unionByName, notes, broken),
    }
