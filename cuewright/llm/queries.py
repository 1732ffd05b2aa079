"""The thin queries over the tables, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from cuewright.llm import bpe, fim, html_text, licenses, line_dedup, mixing, prefix_trie, quality, secrets, sharding, simhash, statements, suffixes, syncmers

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.digest(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(_table(spark, sf_dir, "documents"))
    # A cut may fall inside a character: such bytes show as U+FFFD in the text, while the digest is of the bytes.
    return found.withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.with_shared_starts(prefix_trie.sequences(_table(spark, sf_dir, "conversations"))))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(_table(spark, sf_dir, "documents"))


# What SQL can state of a contract is a query of its own beside the operator's.


def base_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def base_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_suffixes(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_syncmers": op1_syncmers,
        "op2_html": op2_html,
        "op3_bpe": op3_bpe,
        "op4_simhash": op4_simhash,
        "op5_quality": op5_quality,
        "op6_licenses": op6_licenses,
        "op7_mixing": op7_mixing,
        "op8_suffixes": op8_suffixes,
        "op9_sharding": op9_sharding,
        "op10_secrets": op10_secrets,
        "op11_lines": op11_lines,
        "op12_trie": op12_trie,
        "op13_fim": op13_fim,
        "pipeline": corpus_pipeline.run,
        "base_edited": base_edited,
        "base_quality": base_quality,
        "base_mixing": base_mixing,
        "base_suffixes": base_suffixes,
        "base_secrets": base_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_lines": statements.LINES,
        "op12_trie": statements.TRIE,
        "op13_fim": statements.FIM,
        "base_edited": statements.BASE_EDITED,
        "base_quality": statements.BASE_QUALITY,
        "base_mixing": statements.BASE_MIXING,
        "base_suffixes": statements.BASE_SUFFIXES,
        "base_secrets": statements.BASE_SECRETS,
    }
