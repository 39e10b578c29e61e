"""A training corpus from raw documents, in five stages.

Each stage gets all that its predecessor kept, as a table read back from Parquet,
and does its operator's whole work on it; all but the last return the columns of
``documents``. None of the stages limits, samples or skips documents:

1. quality rules: documents that the rules reject go;
2. near duplicates (five-word shingles, similarity 0.8): one of each group stays;
3. repeated passages: bytes that an earlier document has in a string of 50 go;
4. mixing: documents come as often, and as far, as their source's target says;
5. BPE: token digests of every row.

An empty or null text fails the rules of stage 1; a null doc_id passes stages 2
and 3 untouched; repeated rows meet their end in stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveloom.llm import bpe, mixing, neardup, quality, suffixdedup
from sieveloom.llm.common import stage
from sieveloom.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(spark, docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe.token_digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixed sources", mixed_sources),
    ("bpe tokens", bpe_tokens),
]

#: Hash-drawn mixing and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
