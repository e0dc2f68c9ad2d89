"""Identifiers and fingerprints that are the same whenever and wherever they are worked out."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the name space of records' identifiers.
NAMESPACE = "206c7e0cc93c57a99556657e86a565ab"


def name_uuid(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name: the first half of a SHA-1, its version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def record_id(source: Column, version: Column, path: Column, row: Column, field: Column, kind: str = "unit") -> Column:
    """Of where a record stands in its source, never of its text."""
    return name_uuid(F.concat_ws("|", F.lit(kind), source, version, path, row.cast("string"), field))


def _digest(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def chunk_id(strategy: Column, identity: Column, spans: Column, policy_hash: Column | None = None) -> Column:
    """``strategy:digest`` of source, spans (an array of structs with unit_id, start, end) and policy."""
    each = F.transform(spans, lambda s: F.struct(s["end"].alias("end"), s["start"].alias("start"), s["unit_id"].alias("unit_id")))
    policy = policy_hash if policy_hash is not None else F.lit("")
    d = _digest(policy.alias("policy_hash"), identity.alias("source_identity"), each.alias("spans"), strategy.alias("strategy_id"))
    return F.concat(strategy, F.lit(":"), F.substring(d, 1, 32))


def intent_id(category: Column, documents: Column, span: Column) -> Column:
    """Of a category, a set of documents and an array that identifies the evidence."""
    return F.concat(F.lit("intent-"), F.substring(_digest(category.alias("category"), F.array_sort(documents).alias("documents"), span.alias("span")), 1, 24))


def query_id(intent: Column, variant: Column | None = None) -> Column:
    name = F.coalesce(variant, F.lit("base")) if variant is not None else F.lit("base")
    return F.concat(F.lit("query-"), F.substring(F.sha2(F.concat(intent, F.lit(":"), name), 256), 1, 24))


def canonical(payload: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(payload: Any) -> str:
    """SHA-256 of a small configuration, as of a policy, a cache or a run."""
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def schema_fingerprint(frame: DataFrame) -> str:
    """Of ordered column names and types."""
    names, types = [f.name for f in frame.schema], [f.dataType.simpleString() for f in frame.schema]
    return hashlib.sha256(json.dumps({"names": names, "types": types}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def without_text(payload: Any, forbidden: tuple[str, ...] = ("text", "display_text", "query_text", "answer", "quoted_text")) -> Any:
    """The payload, or an error if any key in it would carry text."""
    if isinstance(payload, dict):
        for k, v in payload.items():
            if k in forbidden:
                raise ValueError(f"{k!r} must not leave with a report")
            without_text(v, forbidden)
    elif isinstance(payload, (list, tuple)):
        for v in payload:
            without_text(v, forbidden)
    return payload
