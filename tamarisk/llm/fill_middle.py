"""Fill-in-the-middle: a text is cut in three and its parts are put in an order in which the middle comes last.

Units are runs of ASCII letters and single other code points. A text is kept as its maximal runs of either class: where each
begins and how many units stand before it (a run of letters is one unit, another run as many as it has code points). A
cut after so many units lies in the run that a binary search of those counts finds, and its offset follows from the run's
start, so units are never listed. Only counts and offsets come back from the workers; texts are cut and joined by Spark.

What is chance comes from the digest of a seed and ``doc_id``, so a row gets the same form whenever and wherever it is
made. A text stays plain where it is empty, holds a marker, or its digest says so, and ``restored`` gives back each text
from its output and form alone: no part holds a marker, and a marker can't begin inside another.

A null text is an empty one, a null ``doc_id`` counts as empty digits, repeated rows are cut alike, long texts are cut whole. Empty tables
give no rows; other columns, whatever their names, are kept in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.common import small_batches, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Runs:
    """The maximal runs of letters and of others in a text, with cumulative units."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A)
        first = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.starts = np.concatenate(([0], first)) if len(points) else np.zeros(0, np.int64)
        self.letters = letter[self.starts]
        self.units = np.cumsum(np.where(self.letters, 1, np.diff(self.starts, append=len(points))))
        self.chars = len(points)

    def __len__(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, units: int) -> int:
        """Code points before the cut that follows so many units."""
        if units <= 0:
            return 0
        run = int(np.searchsorted(self.units, units))
        if self.letters[run]:
            return int(self.starts[run + 1]) if run + 1 < len(self.starts) else self.chars
        before = int(self.units[run - 1]) if run else 0
        return int(self.starts[run]) + units - before


def cuts(text: str, one: int, other: int) -> tuple[int, int, int]:
    """Units of a text, and the offsets of the cuts that two numbers choose."""
    runs = Runs(text)
    first, second = sorted((one % (len(runs) + 1), other % (len(runs) + 1)))
    return len(runs), runs.offset(first), runs.offset(second)


def _cut():
    """``cuts`` as a column function."""

    @F.arrow_udf("struct<n:long,a:long,b:long>")
    def cut(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        rows = [cuts(t.as_py(), x, y) for t, x, y in zip(text, one.to_pylist(), other.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["n", "a", "b"])

    return cut


def chances(seed: int | str, key: str = "doc_id") -> list[Column]:
    """Four unsigned integers of 32 bits from a row's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def filled(docs: DataFrame, seed: int | str = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``row`` (the document) and ``fim`` (``n, form, prefix_chars, middle_chars, output``) of every document.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``; ``plain_from`` and ``spm_below`` are the
    hundredths at which a digest says plain, or spm instead of psm.
    """
    small_batches(docs.sparkSession)
    h = chances(seed)
    rows = docs.select(F.struct("*").alias("row"), whole_text().alias("_text"), *[h[i].alias(f"_h{i}") for i in range(4)])
    rows = rows.withColumn("_cut", _cut()("_text", "_h0", "_h1"))
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("_text") == "") | marked | (F.col("_h2") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < spm_below, "spm").otherwise("psm")
    a, b = F.col("_cut.a"), F.col("_cut.b")
    part = lambda start, size: F.substring(F.col("_text"), (start + 1).cast("int"), size.cast("int"))
    rows = rows.select("row", "_text", F.col("_cut.n").alias("n"), form.alias("form"), a.alias("a"), (b - a).alias("m"),
                       part(F.lit(0), a).alias("p"), part(a, b - a).alias("i"), part(b, F.length("_text")).alias("s"))
    joined = lambda *parts: F.concat(*[F.lit(x) if x in (PREFIX, SUFFIX, MIDDLE) else F.col(x) for x in parts])
    output = (
        F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", joined(PREFIX, "p", SUFFIX, "s", MIDDLE, "i"))
        .otherwise(joined(SUFFIX, "s", PREFIX, "p", MIDDLE, "i"))
    )
    kept = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return rows.select("row", F.struct("n", "form", kept("a").alias("prefix_chars"), kept("m").alias("middle_chars"), output.alias("output")).alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    size = len(PREFIX)
    one, two = F.substring(output, F.lit(size + 1), second - size - 1), F.substring(output, second + size, third - second - size)
    middle = F.substring(output, third + size, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(made: DataFrame) -> DataFrame:
    """The columns of ``op13``: counts, and digests of each output and of the text rebuilt from it."""
    rows = made.select("row.doc_id", "fim.*")
    rows = rows.withColumn("restored", restored(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
