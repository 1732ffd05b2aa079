"""Quality metrics with thresholds for subtitles, evaluations and logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cuewright.functions import text as X

# What a default console must not show, and must.
NOISE = (
    "llama_model_loader", "load_tensors", "ggml_backend", "print_info", "init_tokenizer", "control token", "clip_model_loader",
    "clip_ctx", "compute buffer", "encoding audio slice", "audio slice encoded", "decoding audio batch", "audio decoded",
    "ggml 后端设备", "[ASR∅", "[ASR↻", "[ASR〰", "[ASR♻", "[VAD✂", "排版完成", "exe 目录",
)
RESULTS = ("已写出字幕", "转录完成", "[ASR✔")
LOG_RESULTS = ("llama_model_loader", "[ASR✔", "转录完成")
KEPT = r"转录完成：\d+ 段语音 → (\d+) 条字幕"


def subtitle_metrics(cues: DataFrame) -> DataFrame:
    """Per source of ``cues(source_id, start_s, end_s, text)``: cue count, script shares over all characters
    that are not white space, minutes (0.05 at least), widest line, longest cue, most characters, cues of
    under two characters."""
    solid = X.solid("text")
    flat = F.replace("text", F.lit("\n"), F.lit(""))
    own = cues.select(
        "source_id", "end_s", (F.col("end_s") - F.col("start_s")).alias("secs"),
        F.length(solid).cast("long").alias("n"), X.count_of(solid, X.KANA).alias("kana"), X.count_of(solid, X.CJK).alias("cjk"),
        F.array_max(F.transform(F.split("text", "\n"), X.qa_width)).alias("width"),
        F.length(flat).cast("long").alias("chars"), (F.length(X.utrim(flat)) < 2).alias("skinny"),
    )
    total = F.greatest(F.sum("n"), F.lit(1))
    return own.groupBy("source_id").agg(
        F.count("*").alias("n_cues"), (F.sum("kana") / total).alias("kana"), (F.sum("cjk") / total).alias("cjk"),
        F.greatest(F.lit(0.05), F.max("end_s") / 60).alias("minutes"), F.max("width").alias("widest"), F.max("secs").alias("longest"),
        F.max("chars").alias("most_chars"), F.count_if("skinny").alias("n_skinny"),
    )


def subtitle_checks(metrics: DataFrame, transcribed: bool = False) -> DataFrame:
    """Long form ``source_id, check, ok``."""
    c = {
        "density": F.col("n_cues") >= F.col("minutes") * 4, "kana": F.col("kana") <= 0.05, "cjk": F.col("cjk") >= 0.50,
        "width": F.col("widest") <= 40, "longest": F.col("longest") <= 12.0, "chars": F.col("most_chars") <= 44, "skinny": F.col("n_skinny") == 0,
    } if not transcribed else {"kana": F.col("kana") >= 0.15}
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in c.items()))
    return metrics.select("source_id", F.explode(pairs).alias("x")).select("source_id", "x.check", "x.ok")


@F.pandas_udf(DoubleType())
def rounded(shares: pd.Series) -> pd.Series:
    """Four decimals, to the nearest of the exact binary value and to even in a tie, which Spark's functions do not do."""
    return shares.map(lambda x: round(x, 4), na_action="ignore")


def eval_metrics(rows: DataFrame, group: list[str], prompt_col: str = "prompt", out_col: str = "out", report: bool = False) -> DataFrame:
    """Mean script shares of outputs with and without a prompt, and how many of those without leak
    (kana under 5 %). For the ``report`` each row's shares are rounded to four decimals and so are their
    means; else nothing is rounded."""
    exact = lambda x: x
    each = rounded if report else exact
    rows = rows.withColumns({"__kana": each(X.script_ratio(out_col, X.KANA)), "__cjk": each(X.script_ratio(out_col, X.CJK))})
    kana, cjk = F.col("__kana"), F.col("__cjk")
    mt = F.coalesce(F.col(prompt_col), F.lit("")) != ""
    means = {"translated_kana": F.when(mt, kana), "translated_cjk": F.when(mt, cjk), "transcribed_kana": F.when(~mt, kana)}
    out = rows.groupBy(*group).agg(*(F.avg(v).alias(k) for k, v in means.items()), F.count_if(~mt & (kana < 0.05)).alias("leaks"))
    return out.withColumns({k: rounded(k) for k in means}) if report else out


def eval_checks(metrics: DataFrame, most: float = 0.10, least: float = 0.15) -> DataFrame:
    """Metrics with verdicts; null where there was nothing to judge."""
    return metrics.withColumns({"translation_takes_effect": F.col("translated_kana") <= most, "no_forgetting": F.col("transcribed_kana") >= least})


def silence_check(outputs: DataFrame) -> DataFrame:
    """One row of ``outputs(text, error)`` on silent input: all are two characters at most and none failed."""
    quiet = F.length(X.utrim(F.coalesce("text", F.lit("")))) <= 2
    return outputs.agg(F.every(F.col("error").isNull() & quiet).alias("silence_is_empty"))


def noise_hits(lines: DataFrame, markers: tuple[str, ...] = NOISE, group: str = "source_id", line_col: str = "line") -> DataFrame:
    """``group, marker, n_lines``: lines that are not blank and hold a marker, by marker. Markers are a short
    fixed list, tested in one pass."""
    found = F.filter(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(F.col(line_col), m))
    own = lines.where(X.utrim(line_col) != "").select(group, F.explode(found).alias("marker"))
    return own.groupBy(group, "marker").agg(F.count("*").alias("n_lines"))


def required_markers(lines: DataFrame, markers: tuple[str, ...] = RESULTS, group: str = "source_id", line_col: str = "line") -> DataFrame:
    """``group, marker, found``."""
    flags = lines.groupBy(group).agg(*(F.bool_or(F.contains(F.col(line_col), F.lit(m))).alias(f"m{i}") for i, m in enumerate(markers)))
    pairs = F.array(*(F.struct(F.lit(m).alias("marker"), F.coalesce(F.col(f"m{i}"), F.lit(False)).alias("found")) for i, m in enumerate(markers)))
    return flags.select(group, F.explode(pairs).alias("x")).select(group, "x.marker", "x.found")


def line_cap(lines: DataFrame, kept_pattern: str = KEPT, written: str = RESULTS[0], group: str = "source_id", line_col: str = "line") -> DataFrame:
    """``group, n_lines, n_files, n_kept, cap, ok``: kept cues + 4 a file + 8 lines are allowed, or 30 a file + 12
    where no kept count is found. The kept numbers are summed over all matches."""
    kept = F.regexp_extract_all(F.col(line_col), F.lit(kept_pattern), F.lit(1))
    files = (F.length(line_col) - F.length(F.replace(F.col(line_col), F.lit(written), F.lit("")))) / len(written)
    out = lines.groupBy(group).agg(
        F.count_if(X.utrim(line_col) != "").alias("n_lines"),
        F.greatest(F.lit(1), F.sum(files)).cast("long").alias("n_files"),
        F.sum(F.size(kept)).cast("long").alias("n_found"),
        F.coalesce(F.sum(F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))), F.lit(0)).alias("n_kept"),
    )
    cap = F.when(F.col("n_found") > 0, F.col("n_kept") + 4 * F.col("n_files") + 8).otherwise(30 * F.col("n_files") + 12)
    return out.withColumn("cap", cap).withColumn("ok", F.col("n_lines") <= F.col("cap")).drop("n_found")


def first_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; the report's own limit."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def best_by(rows: DataFrame, group: str, value: Column, weight: Column, tie: Column) -> DataFrame:
    """The value of the greatest weight, null counting as 0, the smallest ``tie`` of equals."""
    key = F.struct(F.coalesce(weight, F.lit(0)).alias("w"), (-tie).alias("t"))
    return rows.groupBy(group).agg(F.max_by(value, key).alias("best"))


def density(cues: DataFrame) -> DataFrame:
    """Characters and cues a minute, per source."""
    minutes = F.greatest(F.lit(0.05), F.max("end_s") / 60)
    return cues.groupBy("source_id").agg((F.sum(F.length("text")) / minutes).alias("chars_per_min"), (F.count("*") / minutes).alias("cues_per_min"))


def drop_rate(segments: DataFrame, empty: Column) -> DataFrame:
    """Share of empty segments, per source."""
    return segments.groupBy("source_id").agg(F.avg(empty.cast("int")).alias("drop_rate"))


def buckets(cues: DataFrame, seconds: int = 20) -> DataFrame:
    """Cues and characters by buckets of their start."""
    b = F.expr(f"start_ms div {seconds * 1000}")
    return cues.groupBy("source_id", b.alias("bucket")).agg(F.count("*").alias("n_cues"), F.sum(F.length("text")).alias("n_chars"))


def overlaps(left: DataFrame, right: DataFrame, seconds: int = 20) -> DataFrame:
    """The pairs of cues of two tracks that are on screen together: both bounds and texts, and ``overlap_ms``.

    A cue is put into all buckets of ``seconds`` that it touches. Cues meet in equal buckets, and a pair counts in the first that they
    share, so no cue is compared with another one far from it and no pair comes twice."""
    span = seconds * 1000

    def dealt(cues: DataFrame, side: str) -> DataFrame:
        first, last = F.expr(f"start_ms div {span}"), F.expr(f"greatest(end_ms - 1, start_ms) div {span}")
        own = cues.select("source_id", *(F.col(c).alias(f"{side}_{c}") for c in ("start_ms", "end_ms", "text")), first.alias(f"{side}_first"), F.sequence(first, last).alias("x"))
        return own.withColumn("bucket", F.explode("x")).drop("x")

    met = dealt(left, "left").join(dealt(right, "right"), ["source_id", "bucket"])
    shared = F.least("left_end_ms", "right_end_ms") - F.greatest("left_start_ms", "right_start_ms")
    pairs = met.withColumn("overlap_ms", shared).where((F.col("overlap_ms") > 0) & (F.col("bucket") == F.greatest("left_first", "right_first")))
    return pairs.drop("bucket", "left_first", "right_first")


def side_by_side(left: DataFrame, right: DataFrame, seconds: int = 20) -> DataFrame:
    """Two tracks of the same sources beside one another: for each bucket of ``seconds`` in which a cue of either begins, both sides' texts
    in order and how long cues of both are on screen together from the left cues that begin there."""
    span = seconds * 1000
    bucket = F.expr(f"start_ms div {span}").alias("bucket")

    def told(cues: DataFrame, side: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))), lambda x: x["text"]), " / ")
        return cues.groupBy("source_id", bucket).agg(F.count("*").alias(f"n_{side}"), text.alias(side))

    together = overlaps(left, right, seconds).groupBy("source_id", F.expr(f"left_start_ms div {span}").alias("bucket")).agg(F.sum("overlap_ms").alias("overlap_ms"))
    both = told(left, "left").join(told(right, "right"), ["source_id", "bucket"], "full").join(together, ["source_id", "bucket"], "left")
    return both.select("source_id", "bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right", "overlap_ms")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("left", "right")))


def adjacency(cues: DataFrame) -> DataFrame:
    """Per source: cues that end before they start or with it, and cues that overlap the next by over a millisecond."""
    following = F.lead("start_ms").over(Window.partitionBy("source_id").orderBy("start_ms", "end_ms"))
    own = cues.withColumn("next_ms", following)
    return own.groupBy("source_id").agg(F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("n_backward"), F.count_if(F.col("end_ms") > F.col("next_ms") + 1).alias("n_overlap"))
