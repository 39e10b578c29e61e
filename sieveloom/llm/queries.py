"""The registered queries of these operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, mixing, neardup, quality, sharding, suffixdedup, tokenfile, topk, toxicity, urlfilter
from .common import fresh_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op2_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(spark, _table(spark, sf_dir, "documents"), 24)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), words=2)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    tokenfile.write_tokens(spark, _table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), folder)
    return tokenfile.read_documents(spark, folder)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(spark, _table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, _table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(spark, _table(spark, sf_dir, "documents"), digests=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_tables(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_shard_ring, op3_near_duplicates, op4_token_files, op5_bpe_round_trip, op6_url_rules, op7_quality_rules, op8_top_k, op9_suffix_dedup, op10_toxicity)
}
