"""Checks of annotation records, and evidence beside its structural role and its source's registry entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states a record may have, those that count as reviewed by a person, origins that never do, and roles that carry a decision.
STATES = ("unreviewed", "in_review", "reviewed", "independent_ai_review", "dual_ai_agreed", "dual_ai_disagreement", "human_adjudicated")
VERIFIED_STATES = ("reviewed", "human_adjudicated")
MACHINE_ORIGINS = ("independent_ai_review", "ai_adjudicated_after_independent_second_review", "dual_ai_agreed", "dual_ai_disagreement")
DECIDING_ROLES = ("ruling", "verdict", "disposition", "operative", "holding")


def record_violations(records: DataFrame, selection: DataFrame) -> DataFrame:
    """``record_id, violation`` of ``record_id, unit_id, status, origin, verified, text, registry_text``: a row a rule that a record breaks; ``selection`` has the units that were chosen."""
    chosen = selection.select(F.col("unit_id").alias("_u"), F.lit(True).alias("_chosen")).distinct()
    rows = records.join(chosen, F.col("unit_id") == F.col("_u"), "left")
    verified, state = F.coalesce("verified", F.lit(False)), F.coalesce("status", F.lit(""))
    rules = {
        "unit_not_selected": F.col("_chosen").isNull(), "invalid_status": ~state.isin(*STATES),
        "machine_review_verified": verified & F.coalesce("origin", F.lit("")).isin(*MACHINE_ORIGINS), "verified_not_reviewed": verified & ~state.isin(*VERIFIED_STATES),
        "registry_text_differs": ~F.col("text").eqNullSafe(F.col("registry_text")),
    }
    broken = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in rules.items()]))
    return rows.select("record_id", F.explode(broken).alias("violation"))


def span_violations(spans: DataFrame, records: DataFrame) -> DataFrame:
    """``record_id, kind, violation, place`` of annotated spans ``record_id, kind, place, text, start, end``.

    ``span_not_exact``: the record's text has something else there; ``duplicate_span``: an exact span of its kind that stands before it in the record.
    """
    rows = spans.join(records.select("record_id", F.col("text").alias("_t")), "record_id", "left")
    exact = F.coalesce((F.col("start") >= 0) & (F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")) & (F.length("text") > 0), F.lit(False))
    rows = rows.withColumn("_exact", exact).drop("_t")
    first = rows.where("_exact").groupBy("record_id", "kind", "start", "end").agg(F.min("place").alias("_first"))
    again = rows.where("_exact").join(first, ["record_id", "kind", "start", "end"]).where("place > _first")
    out = [(rows.where("not _exact"), "span_not_exact"), (again, "duplicate_span")]
    parts = [x.select("record_id", "kind", F.lit(name).alias("violation"), "place") for x, name in out]
    return parts[0].unionByName(parts[1])


def evidence_roles(evidence: DataFrame, roles: DataFrame, registry: DataFrame) -> DataFrame:
    """``evidence`` (``query_id, unit_id, source_id``) with ``role`` (lower case, ``unknown`` without one), ``authority`` and ``scope`` of its source (``unknown`` and no terms without an entry) and ``decides``."""
    rows = evidence.join(roles.select("unit_id", F.col("role").alias("_role")), "unit_id", "left")
    rows = rows.join(registry.select("source_id", F.col("authority").alias("_a"), F.col("scope").alias("_s")), "source_id", "left")
    role = F.lower(F.coalesce("_role", F.lit("unknown")))
    return rows.select(*evidence.columns, role.alias("role"), F.coalesce("_a", F.lit("unknown")).alias("authority"), F.coalesce("_s", F.array().cast("array<string>")).alias("scope"), role.isin(*DECIDING_ROLES).alias("decides"))


def evidence_gates(queries: DataFrame, placed: DataFrame) -> DataFrame:
    """``query_id, has_decision, scope_matches`` of ``query_id, terms``: whether any of a query's evidence carries a decision, and whether any source's scope shares a term with it."""
    both = queries.join(placed, "query_id", "left")
    shares = F.arrays_overlap(F.coalesce("terms", F.array().cast("array<string>")), F.coalesce("scope", F.array().cast("array<string>")))
    return both.groupBy("query_id").agg(F.coalesce(F.max("decides"), F.lit(False)).alias("has_decision"), F.coalesce(F.max(shares), F.lit(False)).alias("scope_matches"))
