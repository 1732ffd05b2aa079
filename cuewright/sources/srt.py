"""SRT text: writer, tolerant reader, strict reader of the quality tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.sources.files import file_stem, write_named


def block(index: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.format_string("%d\n%s --> %s\n%s\n\n", index.cast("long"), X.format_timestamp(start_ms), X.format_timestamp(end_ms), X.utrim(text))


def render(cues: DataFrame, order: tuple[str, ...] = ("start_ms",)) -> DataFrame:
    """``source_id, srt``: each source's cues in order, numbered by place."""
    w = Window.partitionBy("source_id").orderBy(*order)
    numbered = cues.withColumn("n", F.row_number().over(w))
    own = numbered.select("source_id", F.struct("n", block(F.col("n"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("b")).alias("x"))
    return own.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("srt"))


def write(cues: DataFrame, path: str, order: tuple[str, ...] = ("start_ms",)) -> None:
    """``<source>.srt`` for each source under ``path``, which is replaced once all files are whole.

    A source is one file, as the format has it: its cues are written one after another by one task, which holds none."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    name = F.concat(file_stem(F.col("source_id")), F.lit(".srt")).alias("name")
    text = block(F.col("n"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("content")
    write_named(cues.withColumn("n", n).select(name, "n", text), path, ("n",))


def output_name(path: Column, raw: bool = False, folder: str | None = None) -> Column:
    """``<folder or the input's>/<stem>.srt`` or ``.raw.srt``."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    home = F.lit(folder.rstrip("/") + "/") if folder else F.regexp_extract(path, r"^(.*/)?", 0)
    return F.concat(home, F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".raw.srt" if raw else ".srt"))


def parse(files: DataFrame, id_col: str = "source_id", text_col: str = "srt") -> DataFrame:
    """``source_id, index, start_ms, end_ms, text`` of whole SRT texts, tolerantly.

    CRLF is LF; the first line with an arrow is the time line and what follows is text, trimmed, blank
    lines left out; blocks without either are dropped; an end is a millisecond after the start at least.
    """
    blocks = files.select(F.col(id_col).alias("source_id"), F.posexplode(F.split(F.replace(text_col, F.lit("\r\n"), F.lit("\n")), "\n\n")).alias("b", "block"))
    lines = blocks.withColumn("lines", F.split("block", "\n"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)
    lines = lines.withColumn("at", at.cast("int")).where("at > 0")
    sides = F.split(F.get("lines", F.col("at") - 1), "-->", 2)
    rest = F.filter(F.transform(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda x: X.utrim(x)), lambda x: x != "")
    lines = lines.select("source_id", "b", X.parse_timestamp(sides[0]).alias("start_ms"), X.parse_timestamp(sides[1]).alias("end_ms"), F.array_join(rest, "\n").alias("text"))
    good = lines.where("start_ms is not null and end_ms is not null and text <> ''")
    index = F.row_number().over(Window.partitionBy("source_id").orderBy("b")).cast("long")
    return good.select("source_id", index.alias("index"), "start_ms", F.greatest(F.col("end_ms"), F.col("start_ms") + 1).alias("end_ms"), "text")


# Fixed value: the time line as the quality tool accepts it.
_STRICT = r"^(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"


def parse_strict(files: DataFrame, id_col: str = "source_id", text_col: str = "srt") -> DataFrame:
    """``source_id, seq, start_s, end_s, text``: blocks of three lines that are not blank or more, the second
    a time line; times in seconds; text lines as they are."""
    blocks = files.select(F.col(id_col).alias("source_id"), F.posexplode(F.split(X.utrim(text_col), "\n\n")).alias("seq", "block"))
    lines = blocks.withColumn("lines", F.filter(F.split("block", "\r\n|\n|\r"), lambda x: X.utrim(x) != ""))
    lines = lines.where("size(lines) >= 3").withColumn("time", F.get("lines", F.lit(1))).where(F.col("time").rlike(_STRICT))
    g = lambda i: F.regexp_extract("time", _STRICT, i).cast("double")
    seconds = lambda a: g(a) * 3600 + g(a + 1) * 60 + g(a + 2) + g(a + 3) / 1000
    return lines.select("source_id", "seq", seconds(1).alias("start_s"), seconds(5).alias("end_s"), F.array_join(F.slice("lines", 3, F.size("lines")), "\n").alias("text"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, srt`` of SRT files; raw variants are left out. Files are the unit, so one is one row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("srt"))
    return files.where(~F.endswith("source_id", F.lit(".raw.srt")))


def read_each(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, srt, error``: a file that is no subtitle file is a row with an ``error`` and no text, and does not keep the
    others from being read. Raw variants are left out; a file without bytes has no row."""
    files = spark.read.format("binaryFile").load(path).where(~F.endswith("path", F.lit(".raw.srt")))
    text = F.col("content").cast("string")
    error = F.when(~F.is_valid_utf8(text), "not UTF-8").when(~F.contains(text, F.lit("-->")), "no time line")
    return files.select(F.col("path").alias("source_id"), F.when(error.isNull(), text).alias("srt"), error.alias("error"))
