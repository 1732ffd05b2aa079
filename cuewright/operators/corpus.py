"""Training sets: lookup joins to translations, task draws, splits, synthetic rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.functions import twister


def last_wins(pairs: DataFrame, key: str = "src", value: str = "dst", order: str = "line_no") -> DataFrame:
    """One row for each key: the value of its last line, the place of its first."""
    return pairs.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def translate(rows: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``target`` and ``match``: exact on the trimmed text, else on the text without closing
    marks, of such keys the first in the table; null and ``miss`` if neither. Keys are whole texts, so whether
    a side is broadcast is left to Spark, which goes by the bytes that it finds at run time."""
    t = last_wins(table)
    exact = t.select(F.col("src").alias("__k"), F.col("dst").alias("__exact"))
    loose = t.groupBy(X.rstrip_sentence_marks("src").alias("__n")).agg(F.min_by("dst", "line_no").alias("__loose"))
    out = rows.withColumn("__key", X.utrim(text_col)).withColumn("__norm", X.rstrip_sentence_marks("__key"))
    out = out.join(exact, F.col("__key") == F.col("__k"), "left").join(loose, F.col("__norm") == F.col("__n"), "left")
    match = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "loose").otherwise("miss")
    return out.select(*rows.columns, F.coalesce("__exact", "__loose").alias("target"), match.alias("match"))


def missing(rows: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose trimmed text is no key of the table."""
    keys = table.select(F.col("src").alias("__k")).distinct()
    return rows.withColumn("__key", X.utrim(text_col)).join(keys, F.col("__key") == F.col("__k"), "left_anti").drop("__key")


def join_transcripts(files: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``files(path, secs)`` with the transcript under its stem, else under its file name; others go."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files.withColumn("__name", name).withColumn("__stem", F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    t = transcripts.select(F.col("key").alias("__k1"), F.nullif(F.col("text"), F.lit("")).alias("__t1"))
    u = t.toDF("__k2", "__t2")
    out = f.join(t, F.col("__stem") == F.col("__k1"), "left").join(u, F.col("__name") == F.col("__k2"), "left")
    return out.withColumn("text", F.coalesce("__t1", "__t2")).where("text is not null").select(*files.columns, "text")


def labelled_text(rows: DataFrame, first: str = "transcription", second: str = "raw_transcription") -> DataFrame:
    """``rows`` with ``text``: the first of the two that is there and not empty, trimmed; rows without go."""
    chosen = F.coalesce(F.nullif(F.col(first), F.lit("")), F.col(second))
    return rows.withColumn("text", X.utrim(chosen)).where("text <> ''")


def within_duration(rows: DataFrame, most: float, least: float | None = 1.0, secs_col: str = "secs") -> DataFrame:
    """Inclusive bounds; without ``least`` there is no lower one."""
    out = rows.where(F.col(secs_col) <= most)
    return out if least is None else out.where(F.col(secs_col) >= least)


def draw(seed: int, row_id: Column) -> Column:
    """A number in [0, 1) fixed by seed and row id, for rows without a place in an order."""
    h = F.sha1(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def with_draws(rows: DataFrame, seed: int, block: int = twister.BLOCK) -> DataFrame:
    """``rows`` with ``draw``: what a generator with this seed gives the row of each ``position``, if every row draws once.

    Rows are dealt by blocks of positions. A task moves the generator ahead to a block's first draw and makes the draws of
    that block only, so neither the rows' partitioning nor their number shows."""
    ahead, state = twister.leaps(block), twister.seeded(seed)
    own = rows.withColumn("__block", F.expr(f"position div {block}")).repartition("__block").sortWithinPartitions("__block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, draws = None, np.zeros(0)
        for batch in batches:
            position = batch.column("position").to_numpy()
            out = np.empty(len(position))
            blocks = position // block
            for b in np.unique(blocks).tolist():
                if b != at:
                    at, draws = b, twister.block_draws(state, b, ahead, block)
                here = blocks == b
                out[here] = draws[position[here] - b * block]
            yield batch.append_column("draw", pa.array(out))

    out = own.drop("__block")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(run, f"{fields}, draw double")


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """A reader's limit: the first ``most`` rows in ``order``."""
    return rows.orderBy(*order).limit(most)


def first_match(candidates: DataFrame, group: str, value: str, rank: str, complete: Column) -> DataFrame:
    """``group`` and ``first``: the value of the candidate of least rank that is complete; null if none is."""
    return candidates.groupBy(group).agg(F.min_by(value, F.when(complete, F.col(rank))).alias("first"))


def position(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, counted from 0 over all rows in ``order``.

    Rows are range partitioned by the first column and numbered in each range; only the ranges' counts
    meet in one place, so no task holds all rows.
    """
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    edges = rows.agg(F.percentile_approx(order[0], [i / n for i in range(1, n)] or [0.5], 1000)).first()[0] or []
    reached = sum((F.when(F.col(order[0]) >= F.lit(e), 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    ranged = rows.withColumn("__r", reached)
    counts = ranged.groupBy("__r").agg(F.count("*").alias("__c"))
    before = counts.select("__r", F.coalesce(F.sum("__c").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__r").orderBy(*order)))
    return own.join(F.broadcast(before), "__r").withColumn("position", F.col("__b") + F.col("__i") - 1).drop("__r", "__b", "__i")


def _drawn(rows: DataFrame, limit: int, asr_ratio: float, seed: int) -> DataFrame:
    """``rows`` with ``__eval``, from position ``limit`` on, ``__mt``, to be translated, and ``__skip``, if that has no target.
    Every row takes one draw, whatever becomes of it."""
    own = with_draws(rows, seed).withColumn("__eval", F.col("position") >= limit)
    own = own.withColumn("__mt", F.col("__eval") | (F.col("draw") >= asr_ratio)).drop("draw")
    return own.withColumn("__skip", F.col("__mt") & F.col("target").isNull())


def records(rows: DataFrame, limit: int, asr_ratio: float, seed: int, prompt: str, language: str = "Japanese") -> DataFrame:
    """Training and evaluation records from ``rows(row_id, audio, text, target, position)``.

    Rows from position ``limit`` on are for evaluation and give two records, translated with the prompt
    and transcribed without. Of the others the seeded generator's draw for the row decides the task. Rows to be
    translated without a target are skipped.
    """
    own = _drawn(rows, limit, asr_ratio, seed)
    mt = F.struct(F.lit("translate").alias("task"), X.tagged(language, F.col("target")).alias("text"), F.lit(prompt).alias("prompt"))
    asr = F.struct(F.lit("transcribe").alias("task"), X.tagged(language, F.col("text")).alias("text"), F.lit("").alias("prompt"))
    made = F.when(F.col("__eval"), F.array(mt, asr)).when(F.col("__mt"), F.array(mt)).otherwise(F.array(asr))
    split = F.when(F.col("__eval"), "eval").otherwise("train").alias("split")
    return own.where("not __skip").select("row_id", split, "audio", F.explode(made).alias("r")).select("row_id", "split", "audio", "r.task", "r.text", "r.prompt")


def with_silence(made: DataFrame, silence: DataFrame) -> DataFrame:
    """``records`` with ``silence_rows`` behind them, as training records of the task ``silence`` without a row id."""
    own = silence.select(F.lit(None).cast(made.schema["row_id"].dataType).alias("row_id"), F.lit("train").alias("split"), "audio", F.lit("silence").alias("task"), "text", "prompt")
    return made.unionByName(own)


def silence_rows(spark: SparkSession, n: int, prompt: str, low: float, high: float, seed: int) -> DataFrame:
    """``n`` silent or faintly noisy samples with an empty target: the first four are of 2 seconds and take
    all combinations of kind and prompt, later ones alternate and have a fixed draw of a length."""
    j = F.col("id")
    secs = F.when(j < 4, F.lit(2.0)).otherwise(F.round(F.lit(low) + draw(seed, j) * (high - low), 2))
    zeros = j % 2 == 0
    prompted = F.when(j < 4, j < 2).otherwise(F.floor(j / 2) % 2 == 0)
    return spark.range(n).select(
        j.alias("j"), secs.alias("secs"), zeros.alias("zeros"), F.format_string("silence_%03d.wav", j).alias("audio"),
        X.tagged("None", F.lit("")).alias("text"), F.when(prompted, prompt).otherwise("").alias("prompt"),
    )


def composition(made: DataFrame) -> DataFrame:
    return made.groupBy("split", "task").agg(F.count("*").alias("n"))


def counters(rows: DataFrame, limit: int, asr_ratio: float, seed: int, n_silence: int) -> DataFrame:
    """One row: ``n_mt, n_asr, n_skipped, n_silence``. A row for evaluation counts as translated."""
    own = _drawn(rows, limit, asr_ratio, seed)
    return own.agg(F.count_if(F.col("__mt") & ~F.col("__skip")).alias("n_mt"), F.count_if(~F.col("__mt")).alias("n_asr"), F.count_if("__skip").alias("n_skipped"), F.lit(n_silence).cast("long").alias("n_silence"))
