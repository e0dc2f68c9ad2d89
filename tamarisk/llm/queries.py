"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.common import table
from tamarisk.llm.oracles import ORACLES


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "kept.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.sentencepiece_codec import decode_documents, encode_documents

    model = _tokenizer("piece_bpe_32k.model")
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"), model), model)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.media import text_media

    return text_media(table(spark, sf_dir, "documents")).withColumnRenamed("name", "doc_id")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.token_store import digests, store

    return digests(store(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.fingerprints import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.packing import digests, packed_documents

    return digests(packed_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.langid import fit, identify_pages, sampled

    return identify_pages(table(spark, sf_dir, "pages"), fit(sampled(table(spark, sf_dir, "documents"))))


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.chat_format import paired, preference_rows, reply_swapped

    return paired(preference_rows(reply_swapped(table(spark, sf_dir, "conversations"))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.toxicity import scores

    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.quality import scores

    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.merkle import audited

    return audited(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarisk.llm.fill_middle import digests, filled

    return digests(filled(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_ngram_jaccard_join, op3_sentencepiece, op4_media_columns, op5_token_store,
        op6_fingerprints, op7_best_fit_packing, op8_language_id, op9_preference_chat, op10_toxicity,
        op11_quality, op12_merkle_manifest, op13_fill_middle,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
