"""A corpus from source rows: statutes, accounts, integrity of chunks and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.operators.chunking import merged_spans
from tamarisk.operators.identity import record_id
from tamarisk.operators.labels import article_groups, parsed_label


def statute_units(rows: DataFrame, source: str, version: str, path: str, law: str, row: str, label: str, text: str) -> DataFrame:
    """``document_id, unit_id, law, ordinal, source_row, article, key, part, marker, text``: one article unit a row, text untouched.

    A law's document is named after its first row; units are numbered by their rows.
    """
    of = lambda r, field, kind: record_id(F.lit(source), F.lit(version), F.lit(path), r, F.lit(field), kind)
    p = rows.select(F.col(law).alias("law"), F.col(row).alias("source_row"), parsed_label(F.col(label)).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    each = Window.partitionBy("law")
    p = p.withColumn("first", F.min("source_row").over(each)).withColumn("ordinal", F.row_number().over(each.orderBy("source_row")))
    return p.select(
        of(F.col("first"), "law_name", "statute").alias("document_id"), of(F.col("source_row"), "text", "unit").alias("unit_id"), "law", "ordinal", "source_row",
        F.col("p.ordinal").alias("article"), "p.key", "p.part", F.col("p.status").alias("marker"), "text",
    )


def statute_documents(rows: DataFrame, source: str, version: str, path: str, law: str, row: str, label: str, text: str) -> DataFrame:
    """``document_id, law, units, status``: unique where all of a law's groups of rows are, else unresolved."""
    groups = article_groups(rows, law, row, label, text).groupBy("law").agg(F.bool_and(F.col("status") == "unique").alias("u"), F.sum("n").alias("units"), F.lit(1).alias("one"))
    first = rows.groupBy(F.col(law).alias("law")).agg(F.min(row).alias("first"))
    name = record_id(F.lit(source), F.lit(version), F.lit(path), F.col("first"), F.lit("law_name"), "statute")
    return groups.join(first, "law").select(name.alias("document_id"), "law", "units", F.when(F.col("u"), "unique").otherwise("unresolved").alias("status"))


def accounting(expected: int, raw: DataFrame, documents: DataFrame, units: DataFrame, excluded: int = 0) -> DataFrame:
    """One row: what was expected, read, made and left out, and whether it adds up."""
    n = lambda frame, name: frame.agg(F.count("*").alias(name))
    out = n(raw, "accounted").crossJoin(n(documents, "documents")).crossJoin(n(units, "units"))
    return out.select(F.lit(expected).cast("long").alias("expected"), "accounted", "documents", "units", F.lit(excluded).cast("long").alias("excluded"), (F.col("accounted") + excluded == expected).alias("complete"))


def grouped_units(units: DataFrame, by: str, ordinal: str, unit: str) -> DataFrame:
    """A document's units as one sorted array of structs (a document's units are few); no ordinal counts as 0."""
    rest = [c for c in units.columns if c not in (by, ordinal, unit)]
    put = F.struct(F.coalesce(F.col(ordinal), F.lit(0)).alias(ordinal), F.col(unit), *rest)
    return units.groupBy(by).agg(F.array_sort(F.collect_list(put)).alias("units"))


def chunk_faults(chunks: DataFrame, spans: DataFrame, units: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: chunks, orphans, invalid spans, displays that aren't their spans, chunks over several sections, and coverage.

    ``chunks``: ``chunk_id, parent_id, fixed, display``; ``spans``: ``chunk_id, place, unit_id, start, end``; ``units``:
    ``unit_id, text``; ``nodes``: ``node_id, parent_id, unit_id`` (of sections). Coverage is of characters that aren't white
    space; overlapping spans count once.
    """
    known = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    missing = lambda frame: frame.where("parent_id is not null").join(known, "parent_id", "left_anti")
    orphans = missing(chunks.select("parent_id")).unionAll(missing(nodes.select("parent_id"))).agg(F.count("*").alias("orphans"))
    rows = spans.join(units, "unit_id", "left")
    sound = F.col("text").isNotNull() & (F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("end") > F.col("start"))
    rows = rows.withColumn("sound", sound)
    invalid = rows.agg(F.count_if(~F.coalesce("sound", F.lit(False))).alias("invalid_spans"))
    piece = F.expr("substring(text, start + 1, end - start)")
    shown = rows.where("text is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("p"))
    shown = chunks.join(shown, "chunk_id", "left").withColumn("want", F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), "\n"), F.lit("")))
    display = shown.agg(F.count("*").alias("chunks"), F.count_if(F.col("display") != F.col("want")).alias("display_mismatches"))
    sections = nodes.where("unit_id is not null").select("unit_id", F.col("node_id").alias("section"))
    over = spans.join(sections, "unit_id").groupBy("chunk_id").agg(F.count_distinct("section").alias("s")).where("s > 1").join(chunks, "chunk_id")
    over = over.agg(F.count("*").alias("cross_section"), F.count_if(~F.col("fixed")).alias("boundary_violations"))
    visible = lambda c: F.length(F.regexp_replace(c, r"(?U)\s", ""))
    merged = merged_spans(rows.where("sound").select(F.col("unit_id").alias("key"), "start", "end"), "key").withColumnRenamed("key", "unit_id")
    covered = merged.join(units, "unit_id").agg(F.coalesce(F.sum(visible(piece)), F.lit(0)).alias("c"))
    whole = units.agg(F.coalesce(F.sum(visible(F.col("text"))), F.lit(0)).alias("w"))
    out = display.crossJoin(orphans).crossJoin(invalid).crossJoin(over).crossJoin(covered).crossJoin(whole)
    return out.select("chunks", "orphans", "invalid_spans", "display_mismatches", "cross_section", "boundary_violations", F.round(F.col("c") / F.greatest("w", F.lit(1)), 8).alias("coverage"))


def page_label(text_length: Column, images: Column, area: Column) -> Column:
    """How a page carries its content, by its images and characters an area."""
    density = text_length / F.greatest(F.lit(1.0), area)
    return F.when((images > 0) & (text_length == 0), "image_only").when(images > 0, "mixed_image_text").when(density > 0.01, "dense_text").otherwise("sparse_text")
