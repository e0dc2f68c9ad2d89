"""Queries over proposed extractions, made for the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import proposals
from tamarisk.queries.tables import table
from tamarisk.registry import query

#: The same proposals as rows: quotes that stand once, more often or nowhere, labels that are known or not, items without a registry, and broken objects.
_TOLD = """t AS (SELECT conv_id * 1000 + turn AS item_id, text, string_split(text, ' ')[1] AS word, left(text, 12) AS head, (conv_id * 1000 + turn) % 11 = 0 AS broken, (conv_id * 1000 + turn) % 5 != 0 AS known FROM conversations),
q AS (SELECT item_id, text, known, unnest([
  {'field': 'regulated_entities', 'rule': NULL, 'place': 0, 'q': word, 'o': NULL}, {'field': 'regulated_entities', 'rule': NULL, 'place': 1, 'q': head, 'o': 5},
  {'field': 'penalties', 'rule': NULL, 'place': 0, 'q': 'no such words', 'o': NULL}, {'field': 'rules[0].action', 'rule': 0, 'place': 0, 'q': head, 'o': NULL},
  {'field': 'rules[0].conditions', 'rule': 0, 'place': 0, 'q': word, 'o': 1}, {'field': 'rules[1].action', 'rule': 1, 'place': 0, 'q': 'no such words', 'o': NULL},
  {'field': 'rules[1].actor', 'rule': 1, 'place': 0, 'q': word, 'o': NULL}, {'field': 'rules[2].action', 'rule': 2, 'place': 0, 'q': 'e', 'o': 3}]) AS s FROM t WHERE NOT broken),
found AS (SELECT item_id, known, s.field AS field, s.rule AS rule, s.place AS place, s.o AS o, len(list_filter(range(1, length(text) - length(s.q) + 2), lambda i: s.q != '' AND substr(text, i, length(s.q)) = s.q)) AS n FROM q),
coded AS (SELECT *, CASE WHEN NOT known THEN 'MISSING_REGISTRY' WHEN n = 0 THEN 'UNSUPPORTED_MODEL_SPAN' WHEN n = 1 AND coalesce(o, 0) != 0 THEN 'INVALID_OCCURRENCE_CORRECTED'
  WHEN n > 1 AND (o IS NULL OR o < 0 OR o >= n) THEN 'AMBIGUOUS_OR_INVALID_OCCURRENCE' END AS code FROM found),
standing AS (SELECT item_id, rule FROM coded WHERE field LIKE '%.action' AND (code IS NULL OR code = 'INVALID_OCCURRENCE_CORRECTED'))"""


def _proposed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    word, head = F.get(F.split("text", " "), F.lit(0)), F.left("text", F.lit(12))
    quote = lambda text, which=None: F.struct((text if not isinstance(text, str) else F.lit(text)).alias("text"), F.lit(which).cast("int").alias("occurrence"))
    rule = lambda modality, action, **more: F.struct(F.lit(modality).alias("modality"), action.alias("action"), *[v.alias(k) for k, v in more.items()])
    parts = {"actor": F.lit(None).cast("struct<text:string,occurrence:int>"), "conditions": F.lit(None).cast("array<struct<text:string,occurrence:int>>"), "deadline_refs": F.lit(None).cast("array<string>")}
    made = F.to_json(F.struct(
        F.array(quote(word), quote(head, 5)).alias("regulated_entities"), F.array(quote("no such words")).alias("penalties"), F.array(F.lit("T001"), F.lit("M001")).alias("deadline_refs"),
        F.array(rule("permission", quote(head), **parts | {"conditions": F.array(quote(word, 1)), "deadline_refs": F.array(F.lit("T001"), F.lit("T009"))}),
                rule("obligation", quote("no such words"), **parts | {"actor": quote(word)}), rule("prohibition", quote("e", 3), **parts)).alias("rules"),
    ))
    raw = turns.select("item_id", F.when(F.col("item_id") % 11 == 0, "not an object").otherwise(made).alias("raw"))
    known = turns.where("item_id % 5 != 0").select("item_id", F.explode(F.array(F.struct(F.lit("T001").alias("label"), F.lit("temporal").alias("kind")), F.struct(F.lit("M001").alias("label"), F.lit("monetary").alias("kind")))).alias("c"))
    return proposals.assembled(turns, known.select("item_id", "c.*"), raw)


@query(f"""WITH {_TOLD},
looked AS (SELECT c.* FROM coded c WHERE rule IS NULL OR field LIKE '%.action' OR EXISTS (SELECT 1 FROM standing s WHERE s.item_id = c.item_id AND s.rule = c.rule)),
refs AS (SELECT t.item_id, t.known, unnest([{{'field': 'deadline_refs', 'place': 0, 'right': true}}, {{'field': 'deadline_refs', 'place': 1, 'right': false}}]) AS r FROM t WHERE NOT broken
  UNION ALL SELECT t.item_id, t.known, unnest([{{'field': 'rules[0].deadline_refs', 'place': 0, 'right': true}}, {{'field': 'rules[0].deadline_refs', 'place': 1, 'right': false}}]) FROM t JOIN standing s ON s.item_id = t.item_id AND s.rule = 0)
SELECT item_id, field, CAST(place AS INT) AS place, code, code = 'INVALID_OCCURRENCE_CORRECTED' AS accepted FROM looked WHERE code IS NOT NULL
UNION ALL SELECT item_id, r.field, CAST(r.place AS INT), CASE WHEN known THEN 'INVALID_CANDIDATE_REFERENCE' ELSE 'MISSING_REGISTRY' END, false FROM refs WHERE NOT known OR NOT r.right
UNION ALL SELECT item_id, 'provider', 0, 'INVALID_PROVIDER_JSON', false FROM t WHERE broken""")
def proposal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposed(spark, sf_dir)["diagnostics"]


@query(f"""WITH {_TOLD}, kept AS (SELECT item_id, rule, CASE rule WHEN 0 THEN 'permission' WHEN 1 THEN 'obligation' ELSE 'prohibition' END AS modality, CASE rule WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS o FROM standing)
SELECT item_id, rule, modality, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o, rule) - 1 AS INT) AS position FROM kept""")
def proposal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposed(spark, sf_dir)["rules"]


@query("""WITH a AS (SELECT conv_id AS record_id, turn AS attempt, CASE WHEN role = 'system' THEN NULL WHEN length(text) % 3 = 0 THEN 'broken' ELSE 'good' END AS kind FROM conversations)
SELECT record_id, CASE WHEN bool_or(coalesce(kind = 'good', false)) THEN 'completed' WHEN bool_or(kind IS NOT NULL) THEN 'failed' ELSE 'pending' END AS status,
  max(attempt) FILTER (kind = 'good') AS attempt, count(*) AS attempts FROM a GROUP BY 1""")
def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as an attempt: without an answer, broken, or a proposal that quotes its text."""
    from tamarisk.operators.replay import outcomes

    turns = table(spark, sf_dir, "conversations")
    quoted = F.to_json(F.struct(F.array(F.struct(F.left("text", F.lit(20)).alias("text"))).alias("regulated_entities")))
    raw = F.when(F.col("role") == "system", F.lit(None)).when(F.length("text") % 3 == 0, "{broken").otherwise(quoted)
    return outcomes(turns.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("attempt"), raw.alias("raw"))).select("record_id", "status", "attempt", "attempts")
