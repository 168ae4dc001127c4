"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardledger.llm.byte_bpe import token_report
from wardledger.llm.centroids import cluster_report
from wardledger.llm.decontaminate import contamination_report
from wardledger.llm.hamming_search import search_report
from wardledger.llm.langid import language_report
from wardledger.llm.language_model import score_report
from wardledger.llm.near_duplicates import duplicate_report
from wardledger.llm.packing import packing_report
from wardledger.llm.prefix_trie import trie_report
from wardledger.llm.pseudonyms import pseudonym_report
from wardledger.llm.secrets import secret_report
from wardledger.llm.sharding import shard_report
from wardledger.llm.transcripts import transcript_report


def tokenizer() -> str:
    """The vocabulary file, installed beside the tokenizer library on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes of text in a shard.
SHARD_BYTES = 64 << 20
#: Equal values get equal pseudonyms wherever the same key is used; production runs bring their own.
DEMONSTRATION_KEY = "demonstration key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_report(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op5_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_report(table(spark, sf_dir, "conversations"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"), tokenizer())


def op9_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_report(table(spark, sf_dir, "embeddings"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_report(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(table(spark, sf_dir, "conversations"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secrets, op2_language_model, op3_pseudonyms, op4_language, op5_transcripts, op6_near_duplicates, op7_shards,
        op8_packing, op9_nearest_codes, op10_contamination, op11_byte_bpe, op12_centroids, op13_prefix_trie,
    )
    return {q.__name__: q for q in found}
