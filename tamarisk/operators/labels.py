"""Headings of numbered articles: number, part and status, without touching the label."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits; ordinals of units (with both genders), of tens, and hundreds; the words of a heading.
DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2)
UNIT_WORDS = {
    "الأولى": 1, "الاولى": 1, "الأول": 1, "الاول": 1, "الحادية": 1, "الحادي": 1, "الثانية": 2, "الثاني": 2, "الثالثة": 3, "الثالث": 3,
    "الرابعة": 4, "الرابع": 4, "الخامسة": 5, "الخامس": 5, "السادسة": 6, "السادس": 6, "السابعة": 7, "السابع": 7,
    "الثامنة": 8, "الثامن": 8, "التاسعة": 9, "التاسع": 9, "العاشرة": 10,
}
TEN_WORDS = {"العشرون": 20, "الثلاثون": 30, "الأربعون": 40, "الاربعون": 40, "الخمسون": 50, "الستون": 60, "السبعون": 70, "الثمانون": 80, "التسعون": 90}
HUNDRED_WORDS = {
    "المائة": 100, "المئة": 100, "مائة": 100, "مئة": 100, "المائتان": 200, "المائتين": 200, "مائتان": 200, "مائتين": 200,
    "الثلاثمائة": 300, "الثلاثمئة": 300, "الأربعمائة": 400, "الأربعمئة": 400, "الاربعمائة": 400, "الاربعمئة": 400, "الخمسمائة": 500,
    "الستمائة": 600, "الستمئة": 600, "السبعمائة": 700, "السبعمئة": 700, "الثمانمائة": 800, "الثمانمئة": 800, "التسعمائة": 900, "التسعمئة": 900,
}
HEADINGS, AFTER, CONTINUED = "المادة|الماده|article", "بعد", "continued|continuation|استمرار|تابع"
PARTS, STATUSES = "part|section|جزء|قسم", "ملغاة|معدلة|مضافة"

# the genitive of tens ends otherwise
_TENS = TEN_WORDS | {w.removesuffix("ون") + "ين": n for w, n in TEN_WORDS.items()}
_HEADING = re.compile(rf"(?:{HEADINGS})\b", re.I)
_PART = re.compile(rf"(?:{PARTS})\s*[/:-]?\s*([0-9]+)", re.I)
_STATUS = re.compile(rf"(?<!\S)({STATUSES})(?!\S)")


def ascii_digits(text: str) -> str:
    return text.translate(DIGITS)


def below_hundred(words: str) -> int | None:
    """Of words without spaces: a unit, a ten, a unit with ten, or a unit and a ten joined by and."""
    for table in (UNIT_WORDS, _TENS):
        if words in table:
            return table[words]
    for ten in ("عشرة", "عشر"):
        unit = UNIT_WORDS.get(words.removesuffix(ten)) if words.endswith(ten) else None
        if unit and unit < 10:
            return 10 + unit
    for word, ten in _TENS.items():
        unit = UNIT_WORDS.get(words.removesuffix("و" + word)) if words.endswith("و" + word) else None
        if unit and unit < 10:
            return ten + unit
    return None


def ordinal_of(words: str) -> int | None:
    """Up to 999; above a hundred the rest comes first, after it the hundred behind a word for after."""
    plain = re.sub(r"[\sـ]+", "", words)
    if plain in HUNDRED_WORDS:
        return HUNDRED_WORDS[plain]
    small, after, hundred = plain.partition(AFTER)
    if after:
        n, base = below_hundred(small), HUNDRED_WORDS.get(hundred)
        return n + base if n and base else None
    return below_hundred(plain)


def article_label(raw: str | None) -> tuple[int | None, int | None, str | None, str | None]:
    """(ordinal, part, status, key) of a complete heading; of anything else no ordinal and no key.

    A part, in brackets or not, never counts as the article's number, and is told even where the rest isn't a number.
    """
    text = ascii_digits((raw or "").strip())
    if not _HEADING.match(text):
        return None, None, None, None
    found = _PART.search(text)
    part = int(found[1]) if found else None
    body = re.sub(r"\([^)]*\)", "", text)
    mark = _STATUS.search(body)
    status = mark[1] if mark else None
    body = (body[: mark.start()] if mark else body).strip()
    rest = body[_HEADING.match(body).end() :] if _HEADING.match(body) else ""
    label = re.sub(r"[\sـ]+", "", rest)
    n = int(label) if re.fullmatch(r"\s*[0-9]+", rest) else ordinal_of(rest)
    if n is None or not 1 <= n <= 999:
        return None, part, None, None
    return n, part, status, f"article:{n}|label:{label}|status:{status or ''}"


def parsed_label(label: Column) -> Column:
    """A struct of ``ordinal, part, status, key``."""

    @F.arrow_udf("struct<ordinal: int, part: int, status: string, key: string>")
    def parse(labels: pa.Array) -> pa.Array:
        # a batch's labels repeat; each is parsed once
        coded = labels.dictionary_encode()
        each = [article_label(x) for x in coded.dictionary.to_pylist()]
        none = article_label(None)
        rows = [none if i is None else each[i] for i in coded.indices.to_pylist()]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, types)], ["ordinal", "part", "status", "key"])

    return parse(label)


def article_groups(rows: DataFrame, law: str, row: str, label: str, text: str) -> DataFrame:
    """``law, key, n, status, consecutive, review`` of a statute's rows grouped by law and structural key.

    A row whose label isn't understood is a group of its own. One row is unique; rows that all name a part are a series
    if the parts differ, else conflicting; labels that say so are a continuation; differing texts conflict; the rest is
    unresolved. ``review`` tells groups of several rows by whether their rows follow each other.
    """
    p = rows.select(F.col(law).alias("law"), F.col(row).alias("row"), F.col(label).alias("label"), F.sha2(text, 256).alias("t"), parsed_label(F.col(label)).alias("p"))
    key = F.coalesce("p.key", F.concat(F.lit("unresolved:"), F.col("row").cast("string")))
    goes_on = F.coalesce(F.col("label").rlike(f"(?i){CONTINUED}"), F.lit(False))
    groups = p.groupBy("law", key.alias("key")).agg(
        F.count("*").alias("n"), F.count("p.part").alias("with_part"), F.count_distinct("p.part").alias("parts"), F.bool_or(goes_on).alias("goes_on"),
        F.count_distinct("t").alias("texts"), (F.max("row") - F.min("row") + 1 == F.count_distinct("row")).alias("consecutive"),
    )
    status = (
        F.when(F.col("n") == 1, "unique").when(F.col("with_part") == F.col("n"), F.when(F.col("parts") == F.col("n"), "explicit_fragment_series").otherwise("conflicting_duplicate"))
        .when(F.col("goes_on"), "continuation_candidate").when(F.col("texts") > 1, "conflicting_duplicate").otherwise("unresolved")
    )
    review = (
        F.when(F.col("n") == 1, None).when(F.col("goes_on") & F.col("consecutive"), "high_confidence_continuation_candidate")
        .when(F.col("consecutive") & (F.col("texts") > 1), "ambiguous_continuation_candidate").otherwise("genuine_conflict_candidate")
    )
    return groups.select("law", "key", "n", status.alias("status"), "consecutive", review.alias("review"))


def law_figures(rows: DataFrame, law: str, label: str) -> DataFrame:
    """Per law: rows, those whose label is understood, those that aren't, distinct numbers, and numbers with several keys."""
    p = rows.select(F.col(law).alias("law"), parsed_label(F.col(label)).alias("p")).select("law", "p.ordinal", "p.key")
    each = p.groupBy("law", "ordinal").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
    known = F.col("ordinal").isNotNull()
    return each.groupBy("law").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("understood"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unresolved"),
        F.count("ordinal").alias("ordinals"), F.count_if(F.col("keys") > 1).alias("ordinals_with_several_keys"),
    )
