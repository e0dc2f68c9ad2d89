"""Two sets of artifacts held against each other: every row, column and type that differs, with tolerances, and gates that decide.

Rows meet by their keys in one full outer join; a key that stands several times on a side is reported and not compared, so no key multiplies rows. Numbers differ if they are further
apart than their column's tolerance (or if only one is a number: nan equals nan); null equals null only. A null key is a key. Columns that only one side has, or that have other types there, are
differences of the schema and aren't compared by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("only_left", "only_right", "repeated_left", "repeated_right", "value_missing_left", "value_missing_right", "value_differs")


def schema_differences(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, type on the left, type on the right) of columns that aren't the same on both sides, by name."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [(c, a.get(c), b.get(c)) for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]


def _apart(left: Column, right: Column, kind: str, tolerance: float) -> Column:
    if kind in ("double", "float"):
        odd = F.isnan(left) | F.isnan(right)
        return F.when(odd, F.isnan(left) != F.isnan(right)).otherwise((left != right) & (F.abs(left - right) > tolerance))
    if tolerance and kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "decimal"):
        return F.abs(left.cast("decimal(38,6)") - right.cast("decimal(38,6)")) > F.lit(tolerance)
    return left != right


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerances: Mapping[str, float] | None = None) -> DataFrame:
    """``keys``, ``kind`` (one of ``KINDS``), ``column``, ``left``, ``right`` (as text): a row a difference."""
    tolerances, bad = dict(tolerances or {}), {c for c, *_ in schema_differences(left, right)}
    if bad & set(keys):
        raise ValueError(f"keys of one type on both sides are needed, not {sorted(bad & set(keys))}")
    kinds, columns = dict(left.dtypes), [c for c in left.columns if c in right.columns and c not in bad and c not in keys]

    def side(frame: DataFrame, mark: str) -> DataFrame:
        rows = frame.groupBy(*keys).agg(F.count("*").alias(f"_n{mark}"), *[F.first(c).alias(f"_{mark}{i}") for i, c in enumerate(columns)])
        return rows.select(*[F.col(k).alias(f"_{mark}k{i}") for i, k in enumerate(keys)], *[c for c in rows.columns if c not in keys])

    same = F.lit(True)
    for i in range(len(keys)):
        same &= F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}"))
    both = side(left, "l").join(side(right, "r"), same, "full_outer")
    nothing = F.lit(None).cast("string")
    note = lambda when, kind, column=nothing, a=nothing, b=nothing: F.when(when, F.struct(F.lit(kind).alias("kind"), column.alias("column"), a.alias("left"), b.alias("right")))
    l, r = F.coalesce("_nl", F.lit(0)), F.coalesce("_nr", F.lit(0))
    found = [note((l > 0) & (r == 0), "only_left"), note((l == 0) & (r > 0), "only_right"), note(l > 1, "repeated_left"), note(r > 1, "repeated_right")]
    one = (l == 1) & (r == 1)
    for i, c in enumerate(columns):
        a, b = F.col(f"_l{i}"), F.col(f"_r{i}")
        text = (F.lit(c), a.cast("string"), b.cast("string"))
        found += [note(one & a.isNull() & b.isNotNull(), "value_missing_left", *text), note(one & a.isNotNull() & b.isNull(), "value_missing_right", *text),
                  note(one & F.coalesce(_apart(a, b, kinds[c], tolerances.get(c, 0.0)), F.lit(False)), "value_differs", *text)]
    named = [F.coalesce(f"_lk{i}", f"_rk{i}").alias(k) for i, k in enumerate(keys)]
    return both.select(*named, F.explode(F.array_compact(F.array(*found))).alias("d")).select(*keys, "d.*")


def content_digest(frame: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """An aggregate: a digest of rows in any order, with their repetitions."""
    own = sorted(columns or frame.columns)
    parts = [F.count("*"), F.sum(F.xxhash64(F.lit(1), *own).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(2), *own))]
    return F.sha2(F.concat_ws("|", F.lit(",".join(own)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)


def verdict(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerances: Mapping[str, float] | None = None, digests: Mapping[str, str] | None = None) -> dict:
    """Counts by kind, the schema's differences, gates (``digests``: what the content of ``left`` or ``right`` has to be) and whether all agree."""
    counts = {r["kind"]: r["n"] for r in differences(left, right, keys, tolerances).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    gates = {side: {"left": left, "right": right}[side].agg(content_digest({"left": left, "right": right}[side]).alias("d")).first()["d"] == want for side, want in (digests or {}).items()}
    schema = schema_differences(left, right)
    return {"counts": {k: counts.get(k, 0) for k in KINDS}, "schema": schema, "gates": gates, "agrees": not counts and not schema and all(gates.values())}
