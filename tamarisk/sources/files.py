"""Readers and writers of the formats that corpora come in, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """A CSV file with header; strict reading fails on malformed rows, and a byte order mark before the first name goes."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", True).option("escape", '"')
    out = (reader.schema(schema) if schema else reader).csv(path)
    names = [c.removeprefix(BOM) for c in out.columns]
    if any(not c.strip() or c.startswith("_c") for c in names):
        raise ValueError(f"{path}: a column has no name")
    return out.toDF(*names)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256, has_bom`` of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf")).alias("has_bom"))


def write_parquet(frame: DataFrame, path: str, by: list[str] = (), mode: str = "errorifexists") -> None:
    """Compressed with zstd; the commit of a job is atomic, and its files become visible together."""
    w = frame.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).json(path)


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def upserted(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """``old`` with the rows of every source that ``new`` has replaced by them; to be written to another path."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*old.columns).unionByName(new)


def validated_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_id, rule`` of chunks (``chunk_id, document_id, display_text, source_spans``) that break the contract."""
    from pyspark.sql import Window

    spans = F.forall("source_spans", lambda s: s["end"] > s["start"])
    rules = {
        "blank_id": F.trim(F.coalesce("chunk_id", F.lit(""))) != "",
        "repeated_id": F.count("*").over(Window.partitionBy("chunk_id")) == 1,
        "blank_text": F.trim(F.coalesce("display_text", F.lit(""))) != "",
        "bad_span": (F.size("source_spans") > 0) & spans,
    }
    marked = chunks.select("chunk_id", *[(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return marked.select("chunk_id", F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in rules]))).alias("rule"))


def page(frame: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in key order; at most 100 at once."""
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit must be from 1 to 100, and offset not negative")
    return frame.orderBy(key).offset(offset).limit(limit)
