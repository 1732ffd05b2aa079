"""Which model files a run takes: a listing of folders as a table, ranked.

The listing is Spark's own, so it works on any store that Spark reads. Rules are those of one folder after another: the language
model is ``model.gguf``, else the only other file of that kind; the audio model is ``mmproj.gguf``, else the only one whose name begins
so; a folder without either is passed over; a folder with several to choose from is an error that counts only if no folder is complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND, LANGUAGE, AUDIO = ".gguf", "model.gguf", "mmproj"


@dataclass(frozen=True)
class Model:
    language: str
    audio: str


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``rank, folder, name`` of the model files that lie in ``folders``; a folder that is not there has none, and
    a file without bytes is not listed."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for rank, folder in enumerate(folders):
        pattern = path_of(f"{folder.rstrip('/')}/*{KIND}")
        if spark._jvm.org.apache.hadoop.fs.FileSystem.get(pattern.toUri(), spark._jsc.hadoopConfiguration()).globStatus(pattern):
            own = spark.read.format("binaryFile").load(pattern.toString()).select("path")
            found.append(own.select(F.lit(rank).alias("rank"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")))
    out = spark.createDataFrame([], "rank int, folder string, name string")
    for own in found:
        out = out.unionByName(own)
    return out


def folders_of(files: DataFrame, group: str | None = None) -> DataFrame:
    """What each folder of ``files(rank, folder, name)`` offers: ``language``, ``audio``, ``error``, null where there is none."""
    keys = [*([group] if group else []), "rank", "folder"]
    ours = F.endswith("name", F.lit(KIND))
    is_audio = F.startswith("name", F.lit(AUDIO))
    pick = lambda kind, best: F.struct(
        F.max(F.when(ours & kind & (F.col("name") == best), F.col("name"))).alias("best"), F.count_if(ours & kind).alias("n"), F.min(F.when(ours & kind, F.col("name"))).alias("only")
    )
    chosen = lambda x: F.coalesce(F.col(f"{x}.best"), F.when(F.col(f"{x}.n") == 1, F.col(f"{x}.only")))
    several = lambda x: F.col(f"{x}.best").isNull() & (F.col(f"{x}.n") > 1)
    seen = files.groupBy(*keys).agg(pick(~is_audio, LANGUAGE).alias("l"), pick(is_audio, f"{AUDIO}{KIND}").alias("a"))
    error = F.when(several("l"), "more than one language model").when(several("a"), "more than one audio model")
    return seen.select(*keys, F.when(error.isNull(), chosen("l")).alias("language"), F.when(error.isNull(), chosen("a")).alias("audio"), error.alias("error"))


def choose(files: DataFrame, group: str | None = None) -> DataFrame:
    """For each ``group`` the first complete folder's ``folder, language, audio``; if there is none, the first ``error``."""
    own = folders_of(files, group)
    whole = F.when(F.col("language").isNotNull() & F.col("audio").isNotNull(), F.col("rank"))
    taken = F.min_by(F.struct("folder", "language", "audio"), whole).alias("m")
    wrong = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("rank"))).alias("wrong")
    found = own.groupBy(*([group] if group else [])).agg(taken, wrong)
    return found.select(*([group] if group else []), "m.folder", "m.language", "m.audio", F.when(F.col("m").isNull(), F.coalesce("wrong", F.lit("no model"))).alias("error"))


def resolve(spark: SparkSession, folders: list[str], language: str | None = None, audio: str | None = None) -> Model:
    """The two files to take. One that is named is taken, and its folder is the only one searched for the other."""
    named = language or audio
    if named:
        folders = [named.rsplit("/", 1)[0] if "/" in named else "."]
    if language and audio:
        return Model(language, audio)
    files = listing(spark, folders)
    if named:  # stands for the half that is not looked for
        other = F.startswith("name", F.lit(AUDIO)) if language else ~F.startswith("name", F.lit(AUDIO))
        half = LANGUAGE if language else f"{AUDIO}{KIND}"
        own = files.where(other)
        files = own.unionByName(own.select("rank", "folder", F.lit(half).alias("name")).distinct())
    found = choose(files).first()
    if found["error"]:
        raise ValueError(f"{found['error']} in {folders}")
    at = lambda name: f"{found['folder']}/{name}"
    return Model(language or at(found["language"]), audio or at(found["audio"]))
