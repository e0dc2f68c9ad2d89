"""Integrity, duplication and privacy checks of tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.plans.lineage import cut

#: Patterns of personal data in a cell. A digit next to a phone number, or a letter or digit next to an IBAN, would make
#: it something else, so the neighbours are part of the pattern and not of the match.
DETECTORS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:^|[^0-9A-Za-z])(\+?[0-9][0-9 ()\-]{7,}[0-9])(?:$|[^0-9A-Za-z])",
    "iban": r"(?:^|[^0-9A-Za-z])([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?:$|[^0-9A-Za-z])",
}
MASK = "[REDACTED]"


def canonical_row(frame: DataFrame, columns: list[str] | None = None) -> Column:
    """A digest of a row's values by column name, nulls apart from empty strings."""
    names = sorted(columns or frame.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def duplicate_figures(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct rows, duplicate rows (beyond the first), groups of equal rows and the largest."""
    groups = frame.groupBy(canonical_row(frame, columns).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )


def split_overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows that two splits share."""
    return a.select(*columns).intersect(b.select(*columns))


def privacy_findings(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, column, detector, masked`` of each cell that holds personal data; values never leave masked."""
    cells = frame.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell")).select(key, "cell.*")
    # an address has its sign, which is found faster than a pattern that tries every letter
    able = {"email": F.contains("value", F.lit("@"))}
    hit = F.array_compact(F.array(*[F.when(able.get(name, F.lit(True)) & F.col("value").rlike(p), F.lit(name)) for name, p in DETECTORS.items()]))
    return cells.select(key, "column", F.explode(hit).alias("detector"), F.lit(MASK).alias("masked"))


def privacy_columns(frame: DataFrame) -> list[str]:
    """Columns whose names suggest identifiers or addresses."""
    import re

    return [c for c in frame.columns if re.search(r"(?i)id|name|address|phone|mail|passport|iban", c)]


def redacted(text: Column) -> Column:
    """Personal data replaced by a mask, white space collapsed."""
    out = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, DETECTORS["email"], MASK)).otherwise(text)
    for name in ("iban", "phone"):
        out = F.regexp_replace(out, DETECTORS[name].replace("(?:", "("), "$1" + MASK + "$3")
    return T.collapsed(out)


def text_profile(frame: DataFrame, column: str, others: list[str]) -> DataFrame:
    """One row of counters: nulls and blanks of each column, distinct texts, short and long texts, suspicious ones."""
    t = F.col(column)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    blank = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"blank_{c}") for c in [column, *others]]
    return frame.agg(
        F.count("*").alias("n"), *blank, F.count_distinct(t).alias("distinct_texts"),
        F.count_if(F.length(t) < 20).alias("shorter_than_20"), F.count_if(F.length(t) > 10000).alias("longer_than_10000"),
        F.count_if(letters < 0.2 * F.length(t)).alias("few_letters"), F.count_if(t.rlike("�")).alias("with_replacement_character"),
    )


def collision_groups(frame: DataFrame, key: str, column: str, policy: str, top: int = 10) -> DataFrame:
    """Normal forms that more than one distinct raw text shares: the ``top`` largest, by units then digest."""
    form = F.sha2(T.normalised(F.col(column), policy), 256)
    groups = frame.where(F.col(column).isNotNull()).groupBy(form.alias("form")).agg(F.count("*").alias("units"), F.count_distinct(F.sha2(F.col(column), 256)).alias("raw_forms"))
    return groups.where("raw_forms > 1").orderBy(F.desc("units"), "form").limit(top)


def text_classes(frame: DataFrame, key: str, column: str) -> DataFrame:
    """``key, class``: rows of equal text share the least key; rows without text are left out."""
    rows = frame.where(F.col(column).isNotNull() & (F.length(column) > 0)).select(F.col(key).alias("key"), F.sha2(column, 256).alias("h"))
    first = cut(rows.groupBy("h").agg(F.min("key").alias("class")))
    return rows.join(first, "h").select("key", "class")


def near_duplicate_texts(frame: DataFrame, key: str, column: str, least: float = 0.96) -> DataFrame:
    """Pairs ``a, b, ratio`` of distinct texts alike by twice the matched characters over all, by longest matching blocks.

    Texts stand for their ``text_classes``, so copies aren't paired. Candidates lose nothing: at a ratio of at least
    ``least`` two texts have close lengths and so few unmatched characters, each spoiling one word at most, that among so
    many of a text's rarest words one is also in the other. Texts with too few words for that bound are probed with all of
    them; verification is exact.
    """
    from difflib import SequenceMatcher

    classes = text_classes(frame, key, column).where("key = class").select(F.col("class").alias("k")).distinct()
    t = frame.select(F.col(key).alias("k"), F.col(column).alias("t")).dropDuplicates(["k"]).join(classes, "k", "left_semi")

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, x.as_py(), y.as_py(), autojunk=False).ratio() for x, y in zip(a, b)], pa.float64())

    words = F.array_distinct(T.words(F.lower("t")))
    rows = t.select("k", "t", F.length("t").alias("n"), F.explode_outer(words).alias("w"))
    rare = rows.groupBy("w").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("df", "w"))
    kept = rows.join(rare, "w").withColumn("place", place)
    # a ratio of at least r leaves at most (1 - r) (n + m) characters unmatched, each of which spoils one word at most
    allowed = F.ceil((1 - least) * F.col("n") * 2 / least) + 1
    probes = kept.where(F.col("place") <= allowed).select("k", "n", "w")
    x, y = probes.selectExpr("k as a", "n as na", "w"), probes.selectExpr("k as b", "n as nb", "w")
    pairs = x.join(y, "w").where(f"a < b and 2 * least(na, nb) >= {least} * (na + nb)").select("a", "b").distinct()
    both = pairs.join(t.selectExpr("k as a", "t as ta"), "a").join(t.selectExpr("k as b", "t as tb"), "b")
    return both.withColumn("ratio", ratio("ta", "tb")).where(F.col("ratio") >= least).select("a", "b", F.round("ratio", 8).alias("ratio"))


def change_ratio(before: Column, after: Column) -> Column:
    """Places at which two texts differ, and the longer one's rest, by the longer one's length."""
    a, b = F.split(before, ""), F.split(after, "")
    n, m = F.length(before), F.length(after)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    return F.when(F.greatest(n, m) == 0, 0.0).otherwise((F.greatest(n, m) - F.when(F.least(n, m) == 0, 0).otherwise(same)) / F.greatest(n, m, F.lit(1)))


def policy_diagnosis(frame: DataFrame, column: str, policy: str) -> DataFrame:
    """One row on what a normal form does to a corpus: change of characters and tokens, vocabulary kept, and collisions."""
    rows = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), T.normalised(F.col(column), policy).alias("y"))
    toks = lambda c: F.array_join(T.tokens(F.col(c)), "\x1f")
    change = rows.agg(F.count("*").alias("units"), F.round(F.avg(change_ratio(F.col("x"), F.col("y"))), 8).alias("character_change"), F.round(F.avg(change_ratio(toks("x"), toks("y"))), 8).alias("token_change"))
    size = lambda c: rows.select(F.explode(T.tokens(F.col(c))).alias("t")).agg(F.count_distinct("t").alias(f"v_{c}"))
    forms = rows.groupBy(F.sha2("y", 256).alias("form")).agg(F.count("*").alias("n"), F.count_distinct(F.sha2("x", 256)).alias("raw"))
    met = F.col("raw") > 1
    collisions = forms.agg(F.count_if(met).alias("collision_groups"), F.round(F.avg(met.cast("double")), 8).alias("form_collision_rate"), F.round(F.coalesce(F.sum(F.when(met, F.col("n"))), F.lit(0)) / F.sum("n"), 8).alias("unit_collision_rate"))
    out = change.crossJoin(size("x")).crossJoin(size("y")).crossJoin(collisions)
    return out.select("units", "character_change", "token_change", F.round(1 - F.col("v_y") / F.greatest("v_x", F.lit(1)), 8).alias("vocabulary_compression"), "collision_groups", "form_collision_rate", "unit_collision_rate")


def normal_form_gate(frame: DataFrame, column: str, policy: str, most_collisions: float = 0.01) -> DataFrame:
    """One row: whether a normal form settles (twice is once), keeps identifiers' separators and collides seldom."""
    y = T.normalised(F.col(column), policy)
    rows = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), y.alias("y")).withColumn("z", T.normalised(F.col("y"), policy))
    kept = F.regexp_extract_all("x", F.lit(IDENTIFIER_MARKS), F.lit(0)) == F.regexp_extract_all("y", F.lit(IDENTIFIER_MARKS), F.lit(0))
    counts = rows.agg(F.count("*").alias("units"), F.count_if(F.col("y") != F.col("z")).alias("unsettled"), F.count_if(~kept).alias("unsafe"))
    forms = rows.groupBy(F.sha2("y", 256).alias("f")).agg(F.count_distinct(F.sha2("x", 256)).alias("raw"))
    rate = forms.agg(F.round(F.avg((F.col("raw") > 1).cast("double")), 8).alias("collisions"))
    return counts.crossJoin(rate).withColumn("eligible", (F.col("unsettled") == 0) & (F.col("unsafe") == 0) & (F.coalesce("collisions", F.lit(0.0)) <= most_collisions))


#: Separators inside identifiers, with a digit on a side.
IDENTIFIER_MARKS = r"(?<=[0-9])[-/.:]|[-/.:](?=[0-9])"


def violations(frame: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` of each rule that a row breaks; a rule of null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return frame.select(key, F.explode(broken).alias("rule"))


def coverage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``field, populated, missing, share, distinct_values``; an empty string counts as missing."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])).alias("x")
    rows = frame.select(values).select("x.*")
    n, full = F.count("*"), F.count("v")
    return rows.groupBy("field").agg(full.alias("populated"), (n - full).alias("missing"), F.round(full / n, 6).alias("share"), F.count_distinct("v").alias("distinct_values"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def metadata_filter(fields: dict[str, list], dates: dict[str, tuple[str | None, str | None]] | None = None) -> Column:
    """Or within a field, and across fields; ranges include both ends; a null never passes. Bad filters are errors."""
    conditions = []
    for field, values in fields.items():
        if not values or any(v is None or str(v).strip() == "" for v in values):
            raise ValueError(f"{field}: no values, or a blank one")
        conditions.append(F.col(field).isin(*values))
    for field, (low, high) in (dates or {}).items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"{field}: the range is inverted")
        if low is not None:
            conditions.append(F.to_date(field) >= F.lit(low).cast("date"))
        if high is not None:
            conditions.append(F.to_date(field) <= F.lit(high).cast("date"))
    return F.coalesce(all_of(conditions), F.lit(False))
