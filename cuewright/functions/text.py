"""Text scalars as Column functions. All count code points; all but the removal of echoes stay in Catalyst."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuewright.functions.echo import collapse_all

# Character classes and marker strings.
WHITE = r"\p{IsWhite_Space}"
PUNCT = (
    r"!-/:-@\[-`{-~\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}"
    r"\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}\x{FE30}-\x{FE4F}\x{B7}"
)
WIDE = (
    r"\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}"
    r"\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFD}"
)
KANA = r"\x{3040}-\x{30FF}"
CJK = r"\x{4E00}-\x{9FFF}"
FILLERS = "哎唉啊呀哇哦噢嗯哼唔哈嘿呃呐欸诶嚄呗"
TAG = "<asr_text>"
STUB_WORDS = ("测试", "样本", "字幕", "翻译", "管线", "验证", "数据", "占位")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utrim(x: Column | str) -> Column:
    """Trim all Unicode white space, which Spark's own ``trim`` does not."""
    return F.regexp_replace(_c(x), f"^{WHITE}+|{WHITE}+$", "")


def urtrim(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"{WHITE}+$", "")


def count_of(x: Column | str, inside: str) -> Column:
    """How many characters of ``x`` are in the character class ``inside``."""
    return F.regexp_count(_c(x), F.lit(f"[{inside}]")).cast("long")


def parse_tagged(raw: Column | str) -> Column:
    """``struct<lang, text>`` of a raw model string: head before the first tag without every leading
    ``language``, trimmed body after it; without a tag the language is empty."""
    s = utrim(raw)
    parts = F.split(s, TAG, 2)
    head = utrim(F.regexp_replace(utrim(parts[0]), "^(language)+", ""))
    tagged = F.size(parts) > 1
    return F.struct(F.when(tagged, head).otherwise("").alias("lang"), F.when(tagged, utrim(F.get(parts, F.lit(1)))).otherwise(s).alias("text"))


def parse_tagged_strict(raw: Column | str) -> Column:
    """The quality tool's variant: the language is one run without white space; else null."""
    return F.nullif(F.regexp_extract(_c(raw), rf"^\s*language\s+(\S+?)\s*{TAG}", 1), F.lit(""))


def after_tag(raw: Column | str) -> Column:
    """Text after the first tag, or all of it."""
    parts = F.split(_c(raw), TAG, 2)
    return F.element_at(parts, -1)


@F.pandas_udf(StringType())
def _collapsed(texts: pd.Series) -> pd.Series:
    there = texts.notna()
    out = texts.copy()
    out[there] = collapse_all(texts[there].tolist())
    return out


def collapse_repeats(x: Column | str) -> Column:
    """Echo removal: a unit of three characters or more that repeats stays once, a shorter unit that
    comes three times or more stays twice; the smallest unit wins, units have 128 characters at most.
    In Arrow batches, bounded in rows and bytes: the regular expression for it takes over twice as long."""
    small_batches()
    return _collapsed(_c(x))


def small_batches(rows: int = 512, size: int = 4 << 20) -> None:
    """Bound the rows and bytes that one Arrow batch hands to Python, but for a single longer row.

    Spark reads these settings when the query runs, so they stay set in the caller's session."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def strip_punct(x: Column | str) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(_c(x), f"[{WHITE}{PUNCT}]", "")


def is_pure_filler(stripped: Column | str) -> Column:
    """Not empty and every character an interjection."""
    return _c(stripped).rlike(f"^[{FILLERS}]+$")


def display_width(x: Column | str) -> Column:
    """Columns on screen: wide characters count two."""
    return F.length(_c(x)).cast("long") + count_of(x, WIDE)


def qa_width(x: Column | str) -> Column:
    """The quality tool's simpler width: everything beyond U+2E80 counts two."""
    return F.length(_c(x)).cast("long") + count_of(x, r"\x{2E81}-\x{10FFFF}")


def solid(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), WHITE, "")


def script_ratio(x: Column | str, inside: str, floor: bool = False) -> Column:
    """Share of the characters other than white space in a class; 0.0 if there are none. With ``floor``
    the count divided by is at least one, which gives the same."""
    s = solid(x)
    n = F.length(s)
    if floor:
        return count_of(s, inside) / F.greatest(F.lit(1), n)
    return F.when(n == 0, F.lit(0.0)).otherwise(count_of(s, inside) / F.greatest(F.lit(1), n))


def truncate(x: Column | str, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis if more were there."""
    return F.concat(F.left(_c(x), F.lit(n)), F.when(F.length(_c(x)) > n, "…").otherwise(""))


def flatten_lines(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("\n"), F.lit(" "))


def rstrip_sentence_marks(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "[。.、！？!?]+$", "")


def tagged(language: str, text: Column | str) -> Column:
    return F.concat(F.lit(f"language {language}{TAG}"), _c(text))


def stub_translate(x: Column | str) -> Column:
    """A fixed pseudo translation: twelve words chosen by the text's SHA-1."""
    words = F.array(*(F.lit(w) for w in STUB_WORDS))
    h = F.sha1(_c(x))
    pick = lambda i: F.element_at(words, (F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int") % len(STUB_WORDS) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), pick), "")


def lang_is_none(x: Column | str) -> Column:
    return F.lower(_c(x)) == "none"


def media_id(url: Column | str) -> Column:
    """The video id in a link; empty if there is none."""
    return F.regexp_extract(_c(url), "(BV[0-9A-Za-z]{10})", 1)


def codec_family(codec: Column | str) -> Column:
    return F.split(_c(codec), r"\.", 2)[0]


def chat_prompt(context: Column | str) -> Column:
    """The chat frame around an audio slot with a context in the system turn."""
    return F.format_string("<|im_start|>system\n%s<|im_end|>\n<|im_start|>user\n<|audio_start|><|audio_pad|><|audio_end|><|im_end|>\n<|im_start|>assistant\n", F.coalesce(_c(context), F.lit("")))


def format_timestamp(ms: Column | str) -> Column:
    """``HH:MM:SS,mmm``; hours may take more digits."""
    m = _c(ms).cast("long")
    part = lambda div, mod: F.expr("1") * F.floor(m / div) % mod
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(m / 3_600_000).cast("long"), part(60_000, 60).cast("long"), part(1000, 60).cast("long"), (m % 1000).cast("long"))


def parse_timestamp(x: Column | str) -> Column:
    """Milliseconds of ``H:M:S,ms`` or ``M:S,ms``, up to the first space; null if it is neither. The
    part after the comma is a number of milliseconds, not a fraction; without it 0."""
    s = F.split(utrim(x), " ", 2)[0]
    halves = F.split(F.replace(s, F.lit("."), F.lit(",")), ",", 2)
    number = lambda c: F.when(c.rlike(r"^\+?[0-9]{1,18}$"), c).try_cast("long")
    ms = F.when(F.size(halves) > 1, number(F.get(halves, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    p = F.split(halves[0], ":")
    at = lambda i: number(F.get(p, F.lit(i)))
    three = at(0) * 3_600_000 + at(1) * 60_000 + at(2) * 1000 + ms
    two = at(0) * 60_000 + at(1) * 1000 + ms
    return F.when(F.size(p) == 3, three).when(F.size(p) == 2, two)
