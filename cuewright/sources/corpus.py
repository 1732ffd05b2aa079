"""Readers and writers of the corpus formats: TSV pairs, JSONL, caches, weight layouts, PCM, logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X

RECORD = "audio string, text string, prompt string"


def parallel_pairs(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``src, dst, line_no`` of ``lines(line_no, line)``: blank and ``#`` lines go, the first tab splits, both
    sides are trimmed and neither is empty."""
    own = lines.where((X.utrim(line_col) != "") & ~F.startswith(line_col, F.lit("#")) & F.contains(line_col, F.lit("\t")))
    parts = F.split(line_col, "\t", 2)
    out = own.select(X.utrim(parts[0]).alias("src"), X.utrim(F.get(parts, F.lit(1))).alias("dst"), "line_no")
    return out.where("src <> '' and dst <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files, lines numbered from 0 in each file.

    Files are read in blocks, as Spark splits them. Lines are numbered in each block, and a row for each block
    carries over how many lines the blocks before it have, so a large file is not one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = lines.withColumn("i", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1)
    return own.join(blocks, ["path", "block"]).select("path", (F.col("before") + F.col("i")).alias("line_no"), "line")


def read_records(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """JSONL records; blank lines are skipped. An empty set is an error where ``required``."""
    out = spark.read.schema(RECORD).json(path)
    if required and out.isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def read_each_record(spark: SparkSession, path: str) -> DataFrame:
    """``audio, text, prompt, error`` of JSONL: a line that is no record is a row with itself as the ``error``."""
    rows = spark.read.schema(f"{RECORD}, error string").option("columnNameOfCorruptRecord", "error").json(path)
    return rows.select("audio", "text", "prompt", "error")


def watched(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` with an ``error`` column, and what will be known when they have been read: ``n_rows`` and ``n_errors``."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("error").isNotNull()).alias("n_errors")), seen


def write_records(rows: DataFrame, path: str) -> None:
    rows.select("audio", "text", "prompt").write.mode("overwrite").json(path)


def dump_transcripts(rows: DataFrame, path: str, text_col: str = "text") -> None:
    """One trimmed line for each row, before any filter."""
    rows.select(X.utrim(X.flatten_lines(text_col)).alias("value")).write.mode("overwrite").text(path)


def report_json(metrics: DataFrame) -> DataFrame:
    """One JSON object for each row, nulls kept."""
    return metrics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def cache(lines: DataFrame) -> DataFrame:
    """``k, v`` of ``lines(line_no, line)`` of JSON objects: the last line of a key wins."""
    own = lines.where(X.utrim("line") != "").select("line_no", F.from_json("line", "k string, v string").alias("j"))
    return own.groupBy(F.col("j.k").alias("k")).agg(F.max_by("j.v", "line_no").alias("v"))


def cached(rows: DataFrame, entries: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``hit``: the cache's value under the text's SHA-1, null if there is none."""
    e = entries.select(F.col("k").alias("__k"), F.col("v").alias("hit"))
    return rows.join(e, F.sha1(text_col) == F.col("__k"), "left").drop("__k")


def weight_layout(layout: DataFrame, n_floats: int, needed: tuple[str, ...] = ()) -> DataFrame:
    """``layout(name, offset, len, shape)`` with offsets in bytes: adds the place in floats and whether it lies
    within ``n_floats``; raises if a needed tensor is missing or outside."""
    out = layout.withColumn("start", F.expr("offset div 4"))
    out = out.withColumn("ok", (F.col("start") + F.col("len") <= n_floats) & (F.col("offset") >= 0))
    if needed:
        have = {r["name"] for r in out.where(F.col("ok") & F.col("name").isin(*needed)).select("name").collect()}
        if missing := sorted(set(needed) - have):
            raise ValueError(f"tensors missing or outside the data: {missing}")
    return out


def pcm_samples(files: DataFrame) -> DataFrame:
    """``source_id, samples array<float>`` of binary files of little-endian 32-bit floats; 1 to 3 bytes at the
    end are no sample and go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            samples = [np.frombuffer(c[: len(c) // 4 * 4], dtype="<f4") for c in batch["content"]]
            yield pd.DataFrame({"source_id": batch["path"], "samples": samples})

    return files.select("path", "content").mapInPandas(run, "source_id string, samples array<float>")


def channel_mean(rows: DataFrame) -> DataFrame:
    """``source_id, samples`` of ``rows(source_id, samples array<float>, channels int)``: interleaved samples as
    their mean over the channels. An incomplete frame at the end goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = zip(batch["samples"], batch["channels"], strict=True)
            mono = [np.asarray(s[: len(s) // n * n], dtype="<f4").reshape(-1, n).mean(axis=1) for s, n in pairs]
            yield pd.DataFrame({"source_id": batch["source_id"], "samples": mono})

    return rows.select("source_id", "samples", "channels").mapInPandas(run, "source_id string, samples array<float>")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, line``; bytes that are not UTF-8 become replacement characters."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("line"))


def untaken(candidates: DataFrame, taken: DataFrame, key: str, rank: str, most: int) -> DataFrame:
    """The next ``most`` candidates by rank that are not taken yet."""
    return candidates.join(taken.select(key).distinct(), key, "left_anti").orderBy(rank, key).limit(most)


def in_passes(candidates: DataFrame, ways: list[Column], rank: str, most: int) -> DataFrame:
    """The ``most`` candidates that are had first, with their ``pass``: all are tried by the first way in order of ``rank``, then, if
    there are too few, those that were not had by the next one."""
    tried = F.lit(None).cast("int")
    for k in range(len(ways), 0, -1):
        tried = F.when(ways[k - 1], F.lit(k)).otherwise(tried)
    return candidates.withColumn("pass", tried).where("pass is not null").orderBy("pass", rank).limit(most)
