"""The registered queries of the text operators: each applies its operator to
its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.llm import (byte_bpe, collocations, minhash, pii, prefix_trie, quality_model, quality_rules, sharding,
                           substring_dedup, suffix_dedup, tiling, token_count, url_rules)
from taxomatch.llm.common import table, written


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The statistics serve the fit and the scores: the texts are read once.
    stats = written(quality_model.with_statistics(docs).drop("text"), "quality-statistics")
    model = quality_model.fit(quality_model.training_rows(stats, table(spark, sf_dir, "labels")))
    scored = quality_model.predict(quality_model.with_score(stats, model))
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Rule(words=3, num=85, den=100))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_pii(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    ).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False
    ).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages).select("page_id", "host", "path", "rule", F.col("verdict"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_windows(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.chained(turns, heads=True))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash": op3_minhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_string_tiling": op7_string_tiling,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_url_rules": op9_url_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sharding": op13_sharding,
}

ORACLE = {
    "op2_quality_rules": quality_rules.oracle(),
    "op9_url_rules": url_rules.oracle(),
    "op11_collocations": collocations.oracle(),
    "op12_prefix_trie": prefix_trie.oracle(),
    "op13_sharding": sharding.oracle(),
}
