"""A training corpus from ``documents``: filter, deduplicate, mask and pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read back as the next stage's ``docs``. All but the last return the columns of ``documents``, with
whatever other columns came in; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import near_dup, packing, pii, quality_rules, suffix_dedup
from clickloom.llm.common import keep
from clickloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null and empty texts go."""
    return quality_rules.rejected_dropped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest ``doc_id``."""
    return near_dup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus; no row goes."""
    return suffix_dedup.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; no row goes."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096."""
    return packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("personal data", personal_data),
    ("packing", packed),
]

# Rolling hashes, suffix order, tokens and packing have no SQL: tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
