"""Text as column expressions: tokens, overlaps and normal forms. All of them return null for null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of letters, digits and underscores, or one visible character besides.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]"
WORD = r"(?U)[\p{L}\p{N}_]+"
_SPACE = r"(?U)[\s\x1c-\x1f]+"

#: What the light and aggressive normal forms remove or map.
TATWEEL = "ـ"
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
ALEF_FORMS = ("آأإٱ", "ا" * 4)
LETTER_FORMS = ("ىة", "يه")
DIGIT_FORMS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2)
PUNCTUATION_FORMS = ("،؛؟٪٫٬“”", ',;?%.,""')
POLICIES = ("raw", "light", "aggressive")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalised(text: Column, policy: str = "light") -> Column:
    """One of three nested normal forms of composed text (compose first where input isn't, see ``composed``)."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    out = collapsed(F.regexp_replace(text, "﻿", ""))
    if policy == "raw":
        return out
    out = F.translate(F.regexp_replace(out, f"{TATWEEL}|{DIACRITICS}", ""), *ALEF_FORMS)
    if policy == "aggressive":
        for forms in (LETTER_FORMS, DIGIT_FORMS, PUNCTUATION_FORMS):
            out = F.translate(out, *forms)
    return collapsed(out)


def composed(text: Column) -> Column:
    """Unicode composed form; Spark has no built-in for it, so texts pass through Arrow."""
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))

    return nfc(text)


def transform_counts(text: Column) -> dict[str, Column]:
    """How many characters each step of the aggressive form would change."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    one_of = lambda forms: count("[" + forms[0] + "]")
    return {
        "bom_removed": count("﻿"),
        "whitespace_mapped": F.when(collapsed(text) != text, count(r"(?U)[\s\x1c-\x1f]")).otherwise(0),
        "tatweel_removed": count(TATWEEL),
        "diacritics_removed": count(DIACRITICS),
        "alef_mapped": one_of(ALEF_FORMS),
        "letters_mapped": one_of(LETTER_FORMS),
        "digits_mapped": one_of(DIGIT_FORMS),
        "punctuation_mapped": one_of(PUNCTUATION_FORMS),
    }


def once(number: Column) -> Column:
    """An integer expression that generated code evaluates once a row, also where rows are exploded afterwards.

    Otherwise a length computed beside an explode is worked out anew, with its pattern matching, for each element.
    """
    return number + F.when(F.rand() < 0, 1).otherwise(0)


def shingles(toks: Column, n: int) -> Column:
    """The set of n consecutive tokens, joined by spaces; empty if there are fewer."""

    def of(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # bound as a lambda's variable, the tokens are worked out once and not for each shingle
    return F.element_at(F.transform(F.array(toks), of), 1)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap_of(a: Column, b: Column) -> Column:
    """The share of a's distinct elements that b has."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def contains_directly(text: Column, other: Column, least: int = 12) -> Column:
    """Whether a text of some length is part of the other, both lower-cased and reduced to words."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_]+", " "))
    return (F.length(plain(text)) >= least) & F.contains(plain(other), plain(text))


def digest_of(*parts: Column) -> Column:
    """A stable identifier: sha-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def is_right_to_left(text: Column) -> Column:
    return F.coalesce(text.rlike("[֐-ࣿ]"), F.lit(False))


def highlighted(text: Column, literal: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of a non-blank literal between two marks."""
    return F.when(F.trim(literal) == "", text).otherwise(F.replace(text, literal, F.concat(F.lit(before), literal, F.lit(after))))
