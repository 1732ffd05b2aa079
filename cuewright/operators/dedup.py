"""Verdicts on segments and cues: empty, fragment, duplicate of the last kept, repeated interjection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.functions.lets import let
from cuewright.scratch import written

MIN_SECS, MIN_CHARS = 2.0, 4  # a segment without a language needs both to be kept
CHUNK = 65_536  # of the first number that orders the cues


def segment_verdict(lang: Column, text: Column, dur_secs: Column, filter_fragments: bool = True) -> Column:
    """``struct<verdict, text>``: ``empty``, ``fragment`` or ``process`` with the collapsed text."""
    return _judged(lang, X.collapse_repeats(X.utrim(F.coalesce(text, F.lit("")))), dur_secs, filter_fragments)


def _judged(lang: Column, collapsed: Column, dur_secs: Column, filter_fragments: bool) -> Column:
    def judged(x: Column) -> Column:
        fragment = F.lit(filter_fragments) & X.lang_is_none(F.coalesce(lang, F.lit(""))) & ((dur_secs < MIN_SECS) | (F.length(x["s"]) < MIN_CHARS))
        verdict = F.when(x["s"] == "", "empty").when(fragment, "fragment").otherwise("process")
        return let(verdict, lambda v: F.struct(v.alias("verdict"), F.when(v == "process", x["t"]).alias("text")))

    return let(F.struct(collapsed.alias("t"), X.strip_punct(collapsed).alias("s")), judged)


def segment_verdicts(utterances: DataFrame, filter_fragments: bool = True) -> DataFrame:
    """``utterances(source_id, seq, start_ms, end_ms, raw)`` with ``lang, verdict, text``."""
    u = X.parse_tagged(F.coalesce("raw", F.lit("")))
    out = utterances.withColumn("u", u).withColumn("c", X.collapse_repeats(X.utrim("u.text")))
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) / 1000.0
    out = out.withColumn("v", _judged(F.col("u.lang"), F.col("c"), dur, filter_fragments))
    return out.select("source_id", "seq", "start_ms", "end_ms", F.col("u.lang").alias("lang"), "v.verdict", F.coalesce("v.text", F.col("u.text")).alias("text"), F.coalesce(X.utrim(F.col("u.text")) != F.col("v.text"), F.lit(False)).alias("collapsed"))


def cue_verdicts(cues: DataFrame, order: tuple[str, ...] = ("seq", "piece")) -> DataFrame:
    """``cues`` with ``verdict``: each cue against the last kept one of its source. The first of ``order`` is a number.

    A cue is compared stripped, ``__s``; what later cues are compared with is its ``__b``: echoes removed, then
    stripped again. Equal cues in a row, empty ones left out, are a run. What becomes of a run depends on the one before it alone:

    * behind an interjection an interjection is dropped;
    * else a run is kept if it differs from the ``__b`` of the run before it, or if that run was dropped itself, for then
      the last kept cue is what that run equals, which this one differs from.

    So a run is kept, is dropped, or does the opposite of the one before it, and the fate of any run is that of the last one
    that is fixed, turned about as often as runs have flipped since: a running count and a last value. Both are taken in
    chunks of a source, and a few values for each chunk are carried over to the next one.
    """
    chunk = F.coalesce(F.floor(F.col(order[0]) / CHUNK), F.lit(-(2**62))).alias("__chunk")
    own = cues.select("*", chunk, X.strip_punct(F.coalesce("text", F.lit(""))).alias("__s"))
    own = own.withColumn("__b", X.strip_punct(X.collapse_repeats("__s"))).withColumn("__f", X.is_pure_filler("__s"))
    own = written(own, "cues")
    at, keys = F.struct(*order), ["source_id", "__chunk"]
    within = Window.partitionBy(*keys).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    chunks = Window.partitionBy("source_id").orderBy("__chunk")
    earlier, reached = chunks.rowsBetween(Window.unboundedPreceding, -1), chunks.rowsBetween(Window.unboundedPreceding, 0)

    said = own.where("__s <> ''")
    one = F.struct("__s", "__b", "__f")
    ends = said.groupBy(*keys).agg(F.max_by(one, at).alias("l")).select(*keys, F.lag("l").over(chunks).alias("__before"))
    runs = _beside(said, ends, keys).withColumn("__p", F.coalesce(F.lag(one).over(within), F.col("__before"))).drop("__before")
    first = F.col("__p").isNull() | (F.col("__s") != F.col("__p.__s"))
    again = F.coalesce(F.col("__f") & F.col("__p.__f"), F.lit(False))
    same = F.coalesce(F.col("__s") == F.col("__p.__b"), F.lit(False))
    runs = runs.withColumns({"__first": first, "__flip": (first & ~again & same).cast("int"), "__fixed": F.when(first & again, 0).when(first & ~same, 1)})
    runs = runs.withColumn("__flips", F.sum("__flip").over(so_far))
    # The fate of the last fixed run less the flips up to it; what a stretch of interjections began with.
    runs = runs.withColumns({"__fate": (F.col("__fixed") + F.col("__flips")) % 2, "__began": F.when(first & F.col("__f") & ~again, F.col("__b"))})

    sums = runs.groupBy(*keys).agg(
        F.sum("__flip").alias("flips"), F.max_by("__fate", F.when(F.col("__fate").isNotNull(), at)).alias("fate"), F.max_by("__began", F.when(F.col("__began").isNotNull(), at)).alias("began")
    )
    sums = sums.withColumn("all", F.sum("flips").over(reached)).withColumn("fate", (F.col("fate") + F.col("flips") + F.col("all")) % 2)
    sums = sums.withColumn("kept", (F.last("fate", ignorenulls=True).over(reached) + F.col("all")) % 2)
    carried = sums.select(*keys, F.lag("kept").over(chunks).alias("__kept_in"), F.last("began", ignorenulls=True).over(earlier).alias("__began_in"))

    last = lambda c, carry: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(carry))
    judged = _beside(runs, carried, keys).withColumns({"__kept": (last("__fate", "__kept_in") + F.col("__flips")) % 2 == 1, "__stretch": last("__began", "__began_in")})
    repeat = F.when(F.col("__f") & (F.col("__s") != F.col("__stretch")), "filler_repeat").otherwise("duplicate")
    more = F.when(F.col("__s") == F.col("__b"), "duplicate").when(F.col("__f"), "filler_repeat").otherwise("keep")
    verdict = F.when(~F.col("__kept"), repeat).when(F.col("__first"), "keep").otherwise(more)
    empty = own.where("__s = ''").select(*cues.columns, F.lit("empty").alias("verdict"))
    return judged.select(*cues.columns, verdict.alias("verdict")).unionByName(empty)


def _beside(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the values that ``carried`` has for their chunk; sources may be null."""
    other = carried.withColumnsRenamed({k: f"{k}__" for k in keys})
    return rows.join(other, rows[keys[0]].eqNullSafe(other[f"{keys[0]}__"]) & (rows[keys[1]] == other[f"{keys[1]}__"])).drop(*(f"{k}__" for k in keys))


def kept_cues(judged: DataFrame, order: tuple[str, ...] = ("seq", "piece")) -> DataFrame:
    """Kept cues, numbered from 1 in each source."""
    numbered = judged.where("verdict = 'keep'").drop("verdict")
    return numbered.withColumn("index", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))


def counters(segments: DataFrame, cues: DataFrame) -> DataFrame:
    """Per source: segments, empty segments and cues, fragments, collapsed, duplicates, interjections, kept."""
    s = segments.groupBy("source_id").agg(
        F.count("*").alias("n_segs"),
        F.count_if(F.col("verdict") == "empty").alias("n_empty_segs"),
        F.count_if(F.col("verdict") == "fragment").alias("n_frag"),
        F.count_if("collapsed").alias("n_collapsed"),
    )
    c = cues.groupBy("source_id").agg(
        F.count_if(F.col("verdict") == "empty").alias("n_empty_cues"),
        F.count_if(F.col("verdict") == "duplicate").alias("n_dup"),
        F.count_if(F.col("verdict") == "filler_repeat").alias("n_filler"),
        F.count_if(F.col("verdict") == "keep").alias("n_kept"),
    )
    return s.join(c, "source_id", "left").select("source_id", "n_segs", (F.col("n_empty_segs") + F.coalesce("n_empty_cues", F.lit(0))).alias("n_empty"), "n_frag", "n_collapsed", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_dup", "n_filler", "n_kept")))
