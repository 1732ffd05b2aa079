"""The corpus pipeline: documents in, token digests out, each stage written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import bpe, mixing, quality, secrets, simhash
from cuewright.llm._shared import scratch_dir

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references are measured over all of ``docs``."""
    return quality.assess(docs, keep_rows=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of five-word shingles), the one of the smallest id."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: a row for each piece of a document that it takes. Every output shard is whole
    in one partition, in its shuffled order."""
    mixed = mixing.mix(docs, shard_col="__cw_shard", order_col="__cw_order")
    return mixing.in_shards(mixed, "__cw_shard", "__cw_order").drop("__cw_shard", "__cw_order")


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every row."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.digest(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("byte-level bpe", encode_bpe),
]

# The divergence of distributions, the fingerprints' components and the mix are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/stage{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
