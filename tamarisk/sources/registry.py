"""A registry of sources: typed rows, their rules, summaries and what may be done with each source."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.quality import violations

#: Fields of permission, conditional ones, and those that an approved source must have settled.
PERMISSIONS = (
    "dataset_licence", "commercial_use", "derivatives", "automated_access_permission", "original_source_rights", "paper_licence", "code_licence",
    "public_display_permission", "model_training_permission", "public_demo_permission", "attribution_required",
)
CONDITIONAL = (
    "dataset_licence", "commercial_use", "derivatives", "automated_access_permission", "public_display_permission", "model_training_permission", "public_demo_permission",
)
SETTLED = ("dataset_licence", "original_source_rights", "automated_access_permission", "public_display_permission", "model_training_permission", "public_demo_permission")
OPEN_LICENCES = ("paper_only", "missing", "unknown", "conflicting")
DIMENSIONS = ("decision", "source_role", "jurisdiction", "privacy_risk", "access_status", "file_format")
#: Operations and purposes that no source allows, operations of mere inspection, and those that fetch.
DENIED_PURPOSES, DENIED_OPERATIONS = ("training", "publishing", "public_display", "public_demo"), ("train", "publish", "public_display", "public_demo")
INSPECTION, FETCHING = ("inspect", "verify", "status", "rebuild"), ("acquire", "import_local")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's CSV as strings; white space at the ends is dropped and an empty cell is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


def _any(columns: tuple[str, ...], value: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.lower(c) == value, F.lit(False))
    return out


def registry_faults(rows: DataFrame) -> DataFrame:
    """``source_id, rule`` of every rule that a row breaks, and of identifiers that repeat."""
    is_ = lambda c, *v: F.coalesce(F.lower(c).isin(*v), F.lit(False))
    approved = is_("decision", "approved")
    rules = {
        "id": F.col("source_id").isNotNull(),
        "no_search_urls": ~F.coalesce(F.lower("canonical_url").rlike(r"/search\?|/search/|\?q=|\?query="), F.lit(False)),
        "positive_permission_needs_evidence": ~_any(PERMISSIONS, "yes") | F.col("permission_evidence_url").isNotNull(),
        "attribution_needs_terms": ~is_("attribution_required", "yes") | F.col("licence_evidence_url").isNotNull() | F.col("terms_url").isNotNull(),
        "open_licence_approves_nothing": ~(is_("dataset_licence", "yes") & is_("licence_status", *OPEN_LICENCES)),
        "conditions_are_written": ~_any(CONDITIONAL, "conditional") | F.col("conditions").isNotNull(),
        "high_risk_is_not_shown": ~(is_("privacy_risk", "high") & is_("public_demo_permission", "yes")),
        "approved_is_accessible": ~(approved & is_("automated_access_permission", "no")),
        "approved_has_a_licence": ~approved | is_("licence_status", "confirmed", "not_applicable"),
        "approved_is_settled": ~(approved & (_any(SETTLED, "unknown") | _any(SETTLED, "no") | is_("privacy_risk", "unknown") | F.col("required_rights").isNotNull())),
        "evaluation_only_is_a_benchmark": ~is_("decision", "evaluation_only") | is_("source_role", "benchmark", "reference"),
        "blocked_has_an_action": ~is_("decision", "blocked_pending_review") | F.col("manual_action").isNotNull(),
    }
    twice = rows.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")
    return violations(rows, "source_id", rules).unionByName(twice.select("source_id", F.lit("unique").alias("rule")))


def registry_summary(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``dimension, value, n`` of every dimension in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")
    return rows.select(each).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def authorised(requests: DataFrame, rows: DataFrame, purposes: dict[str, tuple[str, ...]]) -> DataFrame:
    """``source_id, operation, purpose, allowed, reason`` of each request; what isn't allowed is denied.

    ``purposes`` names what each source may be used for.
    """
    known = rows.select("source_id", F.lit(True).alias("known")).distinct()
    out = requests.join(known, "source_id", "left")
    may, named = F.lit(False), F.lit(False)
    for source, uses in purposes.items():
        named |= F.col("source_id") == source
        may |= (F.col("source_id") == source) & F.col("purpose").isin(*uses)
    denied = F.col("purpose").isin(*DENIED_PURPOSES) | F.col("operation").isin(*DENIED_OPERATIONS)
    good = F.col("operation").isin(*INSPECTION, *FETCHING) & may | (F.col("operation") == "parse") & (F.col("purpose") == "local_parsing")
    reason = (
        F.when(denied, "training, publishing, display and demo are denied").when(F.col("known").isNull(), "the source isn't registered")
        .when(~named, "no acquisition is authorised for this source").when(good, "authorised").otherwise("operation and purpose aren't authorised for this source")
    )
    return out.select("source_id", "operation", "purpose", (reason == "authorised").alias("allowed"), reason.alias("reason"))


def specifications(text: str) -> dict[str, dict[str, Any]]:
    """Source specifications from TOML: tables by source id, each with a version and files."""
    import tomllib

    found = tomllib.loads(text)
    for name, spec in found.items():
        missing = [k for k in ("version", "files") if k not in spec]
        if missing:
            raise ValueError(f"{name}: {', '.join(missing)} missing")
    return found
