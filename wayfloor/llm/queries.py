"""The queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfloor.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.language import language_predictions

    return language_predictions(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.substrings import substring_digest

    return substring_digest(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.chat import chat_digest

    return chat_digest(table(spark, sf_dir, "conversations"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.bpe import token_digest

    return token_digest(table(spark, sf_dir, "documents"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.paragraphs import paragraph_classes

    return paragraph_classes(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.secrets import secrets_digest

    return secrets_digest(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.decontaminate import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfloor.llm.vector_codes import code_digest

    return code_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from wayfloor.llm.sql import ORACLES

    return dict(ORACLES)
