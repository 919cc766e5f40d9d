"""A corpus pipeline of five operators: language, near copies, benchmark passages, secrets, tokens.

Each stage reads what its predecessor wrote.  The first four return documents
with the columns they came with; the last returns the tokens of those left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfloor.llm.bpe import encode
from wayfloor.llm.common import materialize, table
from wayfloor.llm.decontaminate import drop_contaminated
from wayfloor.llm.language import keep_identified, learn_profiles
from wayfloor.llm.minhash import keep_one_of_each
from wayfloor.llm.secrets import redact_secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter, or is too far from the profile of every language that the documents teach."""
    return keep_identified(docs, learn_profiles(docs))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least id stays."""
    return keep_one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; no document goes."""
    return redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, by pieces in order: ``doc_id, piece, last_piece, ids``."""
    return encode(docs).drop("doc_key")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("secret scan", redact),
    ("byte-level BPE", tokenize),
]
#: The stages compute signatures, automata and tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
