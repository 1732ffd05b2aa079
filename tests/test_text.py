"""Text functions against literal cases and against definitions in plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from cuewright.functions import echo
from cuewright.functions import text as X


def column(spark, values, f, kind="s string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {kind}")
    return [r[0] for r in rows.orderBy("i").select(f("s").alias("x")).collect()]


# Cases that the results must equal.
COLLAPSE = {
    "啊！" * 10: "啊！啊！",
    "谢谢谢谢谢谢": "谢谢",
    "好好好": "好好",
    "哈哈": "哈哈",
    "哈" * 6 + "收尾": "哈哈收尾",
    "让我抱抱你！呜呜呜，" * 4: "让我抱抱你！呜呜呜，",
    "对不起，对不起，": "对不起，",
    "我爱你我爱你": "我爱你",
    "真难受！我等你可久了！我等你可久了！你懂的吧？": "真难受！我等你可久了！你懂的吧？",
    "好的好的": "好的好的",
    "你好世界": "你好世界",
    "abababab": "abab",
    "no no no no ": "no ",
}


# The rule as a pattern: alternatives and lengths are tried in its order, an echo is one match.
ECHO = re.compile(r"(.)\1{2,}|(..)\2{2,}|(.{3,128}?)\3+", re.DOTALL)


def defined(text):
    return ECHO.sub(lambda m: 2 * (m[1] or m[2] or "") or m[3], text)


def test_collapse_repeats(spark, monkeypatch):
    rng = random.Random(5)
    more = ["".join(rng.choice("ab啊！\n😀") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    more += ["x" * 300 + ("".join(rng.choice("abcd") for _ in range(n))) * 3 for n in (99, 127, 128, 129, 130)]
    values = list(COLLAPSE) + more
    want = list(COLLAPSE.values()) + [defined(s) for s in more]
    assert column(spark, [*values, None], X.collapse_repeats) == [*want, None]
    monkeypatch.setattr(echo, "BLOCK", 100)
    assert echo.collapse_all(values) == want and echo.collapse_all([]) == []


def test_strip_and_filler(spark):
    cases = {"你好，世界！": "你好世界", "えー…": "えー", "a.b, c!": "abc", "「引用」(括弧)": "引用括弧", "«x»¿": "«x»¿", "々〇": ""}
    assert column(spark, list(cases), X.strip_punct) == list(cases.values())
    ranges = [(0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFE30, 0xFE4F), (0xB7, 0xB7)]
    gone = lambda c: (c.isspace() and not 0x1C <= ord(c) <= 0x1F) or (c.isascii() and unicodedata.category(c)[0] in "PS") or any(a <= ord(c) <= b for a, b in ranges)
    points = ["".join(map(chr, range(a, a + 64))) for a in [*range(32, 0x3100, 64), *range(0xFE00, 0xFFC0, 64)]]
    assert column(spark, points, X.strip_punct) == ["".join(c for c in p if not gone(c)) for p in points]
    fillers = {"嗯嗯": True, "哎呀": True, "": False, "嗯好": False, "太阳": False}
    assert column(spark, list(fillers), X.is_pure_filler) == list(fillers.values())


def test_parse_tagged(spark):
    cases = {
        "language Japanese<asr_text>こんにちは": ("Japanese", "こんにちは"),
        "language None<asr_text>": ("None", ""),
        "language Chinese<asr_text> 你好。 ": ("Chinese", "你好。"),
        "裸文本无标签": ("", "裸文本无标签"),
        "languagelanguage X<asr_text>a<asr_text>b": ("X", "a<asr_text>b"),
    }
    assert [tuple(r) for r in column(spark, list(cases), X.parse_tagged)] == list(cases.values())
    assert column(spark, ["language Two Words<asr_text>x", "language En<asr_text>x"], X.parse_tagged_strict) == [None, "En"]


def test_width_and_ratios(spark):
    assert column(spark, ["abc", "日本語", "ab日本", "ｱｱ"], X.display_width) == [3, 6, 6, 2]
    assert column(spark, ["abc", "ｱｱ"], X.qa_width) == [3, 4]
    assert column(spark, ["あ 亜", "", " 　"], lambda s: X.script_ratio(s, X.KANA)) == [0.5, 0.0, 0.0]


def test_timestamps(spark):
    cases = {0: "00:00:00,000", 1000: "00:00:01,000", 3_723_456: "01:02:03,456", 36_000_000: "10:00:00,000", 360_000_001: "100:00:00,001"}
    assert column(spark, list(cases), X.format_timestamp, "s long") == list(cases.values())
    back = {"01:02:03,456": 3_723_456, "01:02:03.456": 3_723_456, "02:03,456": 123_456, "garbage": None, "00:00:01,5": 1005, "00:00:02 x": 2000, "1:2:3:4": None}
    assert column(spark, list(back), X.parse_timestamp) == list(back.values())


def test_small_scalars(spark):
    assert column(spark, ["abcd", "ab"], lambda s: X.truncate(s, 3)) == ["abc…", "ab"]
    assert column(spark, ["好。。!", "a?b"], X.rstrip_sentence_marks) == ["好", "a?b"]
    assert column(spark, ["　\t a b \n"], X.utrim) == ["a b"]
    assert column(spark, ["x"], X.stub_translate)[0] and F is not None
