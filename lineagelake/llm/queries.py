"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, langid, lexical, lm, minhash, oracles, quality, secret_scan, sharding, warc, whitening
from .common import read
from .simhash import near_duplicates


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.with_digests(secret_scan.scan(read(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(read(spark, sf_dir, "documents"))


def op7_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.with_digests(chat.read_back(*chat.format_chats(chats, byte_bpe_50k())))


def op10_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def byte_bpe_50k() -> tuple[str, str]:
    """Path of the production rank file, and its pre-tokenizer pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = byte_bpe_50k()
    return bpe.with_digests(bpe.round_trip(read(spark, sf_dir, "documents"), path, pattern))


def op11_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash_dedup": op1_simhash_dedup, "op2_lm_scoring": op2_lm_scoring, "op3_language_id": op3_language_id, "op4_secret_scan": op4_secret_scan, "op5_warc": op5_warc, "op6_quality_rules": op6_quality_rules, "op7_chat_prefix_tree": op7_chat_prefix_tree, "op8_benchmark_decontamination": op8_benchmark_decontamination, "op9_byte_bpe": op9_byte_bpe, "op10_kk_sharding": op10_kk_sharding, "op11_tensored_minhash": op11_tensored_minhash, "op12_embedding_whitening": op12_embedding_whitening, "op13_lexical_search": op13_lexical_search}


def oracle_sql() -> dict[str, str]:
    """SQL twins; the others are held against brute force, the library or held-out text in tests/llm."""
    return {
        "op4_secret_scan": oracles.secrets(),
        "op5_warc": oracles.warc(),
        "op6_quality_rules": oracles.QUALITY,
        "op7_chat_prefix_tree": oracles.CHAT,
        "op8_benchmark_decontamination": oracles.DECONTAMINATION,
        "op11_tensored_minhash": oracles.NEAR_COPIES,
        "op13_lexical_search": oracles.LEXICAL,
    }
