"""How the tables stand for the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.session import table


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as utterances, each as long as 500 ms and 60 ms a character."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"))
    dur = (F.lit(500) + 60 * F.length("text")).cast("long")
    end = F.sum(dur).over(Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - dur).select("source_id", "seq", "start_ms", "end_ms", "text", "role")


UTTERANCES = """(select conv_id as source_id, turn as seq, e - d as start_ms, e as end_ms, text, role from (
  select *, cast(sum(d) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as e
  from (select conv_id, turn, role, coalesce(text, '') as text, 500 + 60 * length(coalesce(text, '')) as d from conversations)))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames, by time; a five-hundredth of the value as probability.

    Events are numbered within each day, to which the number of the user's events of earlier days is added,
    so a user with very many events is not one task."""
    day = F.to_date("ts")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "ts", "event_id", (F.col("value") / 500).alias("prob"), day.alias("day"))
    before = Window.partitionBy("source_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = e.groupBy("source_id", "day").agg(F.count("*").alias("n")).select("source_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source_id", "day").orderBy("ts", "event_id")) - 1
    return e.withColumn("place", place).join(days, ["source_id", "day"]).select("source_id", (F.col("before") + F.col("place")).alias("frame_idx"), "prob")


FRAMES = """(select user_id as source_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, value / 500 as prob from events)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table: the benchmark's texts with closing marks and their stand-in translations."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("text").alias("src"), F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("dst"), F.col("item_id").alias("line_no"))
