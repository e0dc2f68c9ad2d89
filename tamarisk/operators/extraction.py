"""Dates, durations, amounts, shares and references in texts: exact spans and one written form for each value."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.operators.labels import TEN_WORDS, UNIT_WORDS, ascii_digits, ordinal_of

#: Names of months, numerals, units, currencies and the words that end a regulation's name, as the source language writes them.
MONTHS = {
    "يناير": 1, "فبراير": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "مايو": 5, "يونيو": 6, "يوليو": 7, "أغسطس": 8, "اغسطس": 8,
    "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12,
}
HIJRI_MONTHS = {
    "محرم": 1, "صفر": 2, "ربيع الأول": 3, "ربيع الاول": 3, "ربيع الآخر": 4, "ربيع الاخر": 4, "جمادى الأولى": 5, "جمادى الاولى": 5,
    "جمادى الآخرة": 6, "جمادى الاخرة": 6, "رجب": 7, "شعبان": 8, "رمضان": 9, "شوال": 10, "ذو القعدة": 11, "ذو الحجة": 12,
}
ONES = {
    "واحد": 1, "واحدة": 1, "أحد": 1, "إحدى": 1, "اثنان": 2, "اثنين": 2, "اثنتان": 2, "اثنتين": 2, "اثنا": 2, "اثني": 2, "ثلاثة": 3, "ثلاث": 3,
    "أربعة": 4, "أربع": 4, "خمسة": 5, "خمس": 5, "ستة": 6, "ست": 6, "سبعة": 7, "سبع": 7, "ثمانية": 8, "ثماني": 8, "ثمان": 8, "تسعة": 9, "تسع": 9,
}
TEN, HUNDRED, THOUSAND = ("عشرة", "عشر"), ("مائة", "مئة"), ("آلاف", "الاف", "ألف", "الف")
TENS = {"عشرين": 20, "ثلاثين": 30, "أربعين": 40, "خمسين": 50, "ستين": 60, "سبعين": 70, "ثمانين": 80, "تسعين": 90}
HUNDREDS = {"خمسمائة": 500, "خمسمئة": 500}
UNITS = {
    "day": ("يومين", "يوماً", "يومًا", "يوما", "يوم", "أياماً", "أيامًا", "أياما", "أيام", "ايام", "روزاً", "روزا", "روز"),
    "month": ("شهرين", "شهراً", "شهرًا", "شهرا", "شهر", "أشهر", "اشهر"),
    "year": ("سنتين", "سنةً", "سنة", "سنوات", "عامين", "عام", "أعوام"),
}
ALONE = {"يوم": "1 day", "يوم واحد": "1 day", "شهر": "1 month", "شهر واحد": "1 month", "شهرين": "2 month", "سنة": "1 year", "سنة واحدة": "1 year", "سنتين": "2 year"}
CURRENCY = r"(?:SAR|ريال(?:\s+سعودي)?|ر\.س|ربال|ريإل|ربإل)"
REGULATIONS = ("نظام", r"اللائحة\s+التنفيذية")
NOT_OF_A_NAME = ("بعد", "دون", "دعوى", "جواب", "الجلسة", "على", "من", "في", "قبل", "المالي", "كيفية")

_N = r"[\d٠-٩۰-۹]"
_L = "[ء-ي]"


def _any(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True))


_UNIT_OF = {w: u for u, ws in UNITS.items() for w in ws}
_WORDS = {**ONES, **TENS, **HUNDREDS, **dict.fromkeys(TEN, 10), **dict.fromkeys(HUNDRED, 100)}
_NUMERAL = rf"(?:{_any(_WORDS)})(?:\s*و?(?:{_any([*_WORDS, *THOUSAND])}))*"
_AMOUNT = rf"(?:{_N}[\d٠-٩۰-۹\s.,٬٫]*|{_NUMERAL})"
_TENS_OF = [*TEN_WORDS, *(w.removesuffix("ون") + "ين" for w in TEN_WORDS)]
_ORDINAL = rf"(?:{_any(UNIT_WORDS)})(?:\s+(?:{_any(TEN)})|\s+و(?:{_any(_TENS_OF)}))?|(?:{_any(_TENS_OF)})"
_MARKS = "[‎‏]*"
PATTERNS = {
    "date": re.compile(rf"{_N}{{1,2}}\s*[/\-.]\s*{_N}{{1,2}}\s*[/\-.]\s*{_N}{{4}}\s*(?:هـ|ه)?"),
    "duration": re.compile(
        rf"(?<!{_L})(?:{_MARKS}\)\s*{_N}+\s*\({_MARKS}\s*(?:{_any(_UNIT_OF)})|\(?\s*(?:{_N}+|{_NUMERAL})\s*\)?\s*(?:{_any(_UNIT_OF)})|{_any(ALONE)})(?!{_L})"
    ),
    "money": re.compile(rf"{_AMOUNT}\s*{CURRENCY}", re.I),
    "percentage": re.compile(rf"{_AMOUNT}\s*(?:%|٪|في\s+المائة)"),
    "article": re.compile(rf"(?:(?<!{_L})|(?<=و))الم(?:ادة|اده)\s*(?:\(\s*(?:{_N}+|{_ORDINAL})\s*\)|{_N}+|{_ORDINAL})(?!{_L})"),
}
_REGULATION = re.compile(rf"(?<!{_L})(?:{'|'.join(REGULATIONS)})(?!{_L})")
_NAME = re.compile(rf"(?:\s+(?!(?:{_any(NOT_OF_A_NAME)})(?!{_L})){_L}+){{1,6}}")
TYPES = {"date": "temporal", "duration": "temporal", "money": "monetary", "percentage": "percentage", "article": "article", "regulation": "regulation"}


def plain_number(raw: str) -> str | None:
    """A decimal without thousands separators. Where both separators occur the later one is the decimal one; a single
    comma is decimal unless three digits follow."""
    s = re.sub(r"\s", "", ascii_digits(raw)).replace("٬", ",").replace("٫", ".").strip(",")
    if "," in s and "." in s:
        decimal = max(",.", key=s.rfind)
        other = "." if decimal == "," else ","
        s = s.replace(other, "").replace(decimal, ".")
    elif s.count(",") == 1 and len(s.split(",")[1]) != 3:
        s = s.replace(",", ".")
    s = s.replace(",", "").lstrip("+").rstrip(".")
    if not re.fullmatch(r"-?\d+(\.\d+)?", s):
        return None
    whole, dot, rest = s.partition(".")
    return (whole.lstrip("0") or "0") + dot + rest


def numeral(words: str) -> int | None:
    """Ones, teens, tens, hundreds and thousands, joined by and or not."""
    tokens = re.findall(rf"و?(?:{_any([*_WORDS, *THOUSAND])})", words)
    if not tokens or re.sub(r"\s", "", words) != "".join(tokens):
        return None
    done = now = 0
    for t in tokens:
        w = t if t in _WORDS or t in THOUSAND else t[1:]
        if w in THOUSAND:
            done, now = done + (now or 1) * 1000, 0
        elif w in HUNDRED and 1 <= now <= 9:
            now *= 100
        else:
            now += _WORDS[w]
    return done + now


def number_of(raw: str) -> str | None:
    """Digits or a numeral."""
    got = plain_number(raw)
    if got is None:
        n = numeral(raw.strip(" ()"))
        got = None if n is None else str(n)
    return got


Value = tuple[str | None, str, str | None]


def date_value(raw: str) -> Value:
    """(yyyy-mm-dd, status, calendar); no calendar is converted, and days or months out of range are partial.

    Numeric dates are of the lunar calendar if marked so; dates with a month's name also from the year 1300 on.
    """
    s = ascii_digits(raw)
    m = re.search(r"(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{4})\s*(هـ|ه)?", s)
    if m:
        d, mo, y = (int(m[i]) for i in (1, 2, 3))
        calendar = "hijri" if m[4] else "gregorian"
        return (f"{y:04d}-{mo:02d}-{d:02d}", "normalized", calendar) if 1 <= d <= 31 and 1 <= mo <= 12 else (None, "partial", calendar)
    m = re.search(rf"(\d{{1,2}})\s+({_any([*MONTHS, *HIJRI_MONTHS])})\s+(\d{{4}})(\s*(?:هـ|ه))?", s)
    if not m:
        return None, "unresolved", None
    name, y = re.sub(r"\s+", " ", m[2]), int(m[3])
    return f"{y:04d}-{MONTHS.get(name) or HIJRI_MONTHS[name]:02d}-{int(m[1]):02d}", "normalized", "hijri" if m[4] or y >= 1300 else "gregorian"


def _with_number(unit: str) -> Callable[[str], Value]:
    def value(raw: str) -> Value:
        n = number_of(re.sub(rf"\s*(?:{CURRENCY}|%|٪|في\s+المائة)\s*$", "", raw, flags=re.I))
        return (n + unit, "normalized", None) if n else (None, "unresolved", None)

    return value


def duration_value(raw: str) -> Value:
    s = re.sub(r"\s+", " ", raw.strip(" ‎‏"))
    if s in ALONE:
        return ALONE[s], "normalized", None
    m = re.fullmatch(rf"[()]?\s*(.+?)\s*[()]?{_MARKS}\s*({_any(_UNIT_OF)})", s)
    n = m and number_of(m[1])
    if not n:
        return None, "unresolved", None
    n = str(int(n)) if n.isdigit() else n
    return f"{n} {_UNIT_OF[m[2]]}{'' if n == '1' else 's'}", "normalized", None


def article_value(raw: str) -> Value:
    s = re.sub(r"^و?الم(?:ادة|اده)\s*", "", raw.strip()).strip(" ()")
    digits = ascii_digits(s)
    n = int(digits) if digits.isdigit() else ordinal_of(s)
    return (str(n), "normalized", None) if n is not None else (None, "unresolved", None)


VALUES: dict[str, Callable[[str], Value]] = {
    "date": date_value, "duration": duration_value, "money": _with_number(" SAR"), "percentage": _with_number("%"), "article": article_value,
    "regulation": lambda raw: (raw, "partial", None),
}


def regulations(text: str) -> list[tuple[int, int]]:
    """Places of named regulations: up to six words behind a word for one, to the first that can't be of a name.

    After the shorter word a single word must have the article.
    """
    out = []
    for m in _REGULATION.finditer(text):
        name = _NAME.match(text, m.end())
        words = name.group().split() if name else []
        if words and (m.group() != REGULATIONS[0] or len(words) > 1 or words[0].startswith("ال")):
            out.append((m.start(), name.end()))
    return out


def spans_of(text: str) -> list[dict]:
    """All candidates of a text in order; a span is listed once, under the first kind that finds it."""
    places = {kind: [m.span() for m in pattern.finditer(text)] for kind, pattern in PATTERNS.items()} | {"regulation": regulations(text)}
    seen: dict[tuple[int, int], dict] = {}
    for kind, spans in places.items():
        for start, end in spans:
            if (start, end) not in seen:
                raw = text[start:end]
                value, status, calendar = VALUES[kind](raw)
                if kind == "date" and status == "unresolved":
                    value, status, calendar = duration_value(raw)
                seen[start, end] = {"kind": kind, "type": TYPES[kind], "start": start, "end": end, "raw": raw, "value": value, "status": status, "calendar": calendar}
    return [seen[k] for k in sorted(seen)]


_SPAN = pa.struct([("kind", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("value", pa.string()), ("status", pa.string()), ("calendar", pa.string())])


def candidate_spans(text: Column) -> Column:
    @F.arrow_udf("array<struct<kind:string,type:string,start:int,end:int,raw:string,value:string,status:string,calendar:string>>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t or "") for t in texts.to_pylist()], pa.list_(_SPAN))

    return find(text)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, type, start, end, raw, value, status, calendar, label``; labels number a document's candidates of each type.

    Numbers are given in the array of a document's spans, so nothing is shuffled.
    """
    rows = docs.select("doc_id", candidate_spans(F.col("text")).alias("all"))
    rows = rows.select("doc_id", "all", F.posexplode("all").alias("at", "c"))
    n = F.size(F.filter(F.slice("all", F.lit(1), F.col("at") + 1), lambda x: x["type"] == F.col("c.type")))
    return rows.select("doc_id", "c.*", F.concat(F.upper(F.substring("c.type", 1, 1)), F.lpad(n.cast("string"), 3, "0")).alias("label"))


def extracted(docs: DataFrame) -> DataFrame:
    """One row a document: its text's digest, all candidates, and those that refer to articles and to regulations.

    All of it is in the document's own row, so nothing is shuffled, joined or sent to the driver.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), candidate_spans(F.col("text")).alias("all"))
    rows = rows.select("doc_id", "fingerprint", F.transform("all", _labelled).alias("candidates"))
    of = lambda kind, name: F.transform(F.filter("candidates", lambda x: x["type"] == kind), lambda x: x["label"]).alias(name)
    return rows.select("doc_id", "fingerprint", F.when(F.size("candidates") > 0, F.col("candidates")).alias("candidates"), of("article", "articles"), of("regulation", "regulations"))


def _labelled(c: Column, at: Column) -> Column:
    """A candidate of ``all`` with its label: which of its type it is."""
    n = F.size(F.filter(F.slice("all", F.lit(1), at + 1), lambda x: x["type"] == c["type"]))
    label = F.concat(F.upper(F.substring(c["type"], 1, 1)), F.lpad(n.cast("string"), 3, "0"))
    return F.struct(label.alias("label"), *[c[x].alias(x) for x in ("type", "start", "end", "raw", "value", "status", "calendar")])


def rules_of(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed rules checked against a document's candidates: ``doc_id, place, modality, group, accepted, reason``.

    ``proposed``: ``doc_id, place, modality, text, start, end, unit_text, refs``; a rule stands if its text is what the unit has
    between start and end, and every label it refers to is among ``known(doc_id, label)``. ``group`` sorts them into
    obligations, prohibitions, permissions and other rules.
    """
    labels = known.groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    rows = proposed.join(labels, "doc_id", "left")
    exact = F.col("text") == F.expr("substring(unit_text, start + 1, end - start)")
    stray = F.size(F.array_except(F.coalesce("refs", F.array().cast("array<string>")), F.coalesce("labels", F.array().cast("array<string>")))) > 0
    reason = F.when(~F.coalesce(exact, F.lit(False)), "span_not_exact").when(stray, "unknown_reference")
    m = F.lower("modality")
    group = F.when(m == "obligation", "obligations").when(m == "prohibition", "prohibitions").when(m == "permission", "permissions").otherwise("others")
    return rows.select("doc_id", "place", "modality", group.alias("group"), reason.isNull().alias("accepted"), reason.alias("reason"))


def labelled(rows: DataFrame, by: list[str], kind: str, order: list[str]) -> DataFrame:
    """``label``: a running number of each kind within a group, in order."""
    n = F.row_number().over(Window.partitionBy(*by, kind).orderBy(*order))
    return rows.withColumn("label", F.concat(F.upper(F.substring(kind, 1, 1)), F.lpad(n.cast("string"), 3, "0")))
