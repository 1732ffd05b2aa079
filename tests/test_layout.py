"""Layout, verdicts, SRT: literal cases, invariants, the statements."""

import random

import duckdb
import pandas as pd

from cuewright.functions import echo
from cuewright.functions import text as X
from cuewright.operators import dedup, layout
from cuewright.plans import statements
from cuewright.sources import srt


def stated(sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.register(name, pd.DataFrame(rows, columns=columns))
    return con.execute(sql).fetchall()


def cues(spark, rows):
    return spark.createDataFrame([("s", i, a, b, t) for i, (a, b, t) in enumerate(rows)], "source_id string, seq int, start_ms long, end_ms long, text string")


def test_split_cases(spark):
    # Cases that the results must equal.
    text = "第一句话在这里。第二句话也在这里。第三句话结束了。"
    eight = "".join(f"第{k}句话在这里。" for k in range(8))
    long_ = "あ" * 60 + "，" + "い" * 60
    crowd = "赛翁的马跑掉了，村民们聚拢过来大喊大叫，" * 4

    def split(*rows, secs=7.0, chars=0):
        out = [[] for _ in rows]
        for r in layout.split_long_cues(cues(spark, rows), secs, chars).orderBy("seq", "piece").collect():
            out[r["seq"]].append((r["start_ms"], r["end_ms"], r["text"]))
        return out

    (parts,) = split((10_000, 30_000, text), secs=8.0)
    assert len(parts) >= 2 and parts[0][0] == 10_000 and parts[-1][1] == 30_000
    assert "".join(t for *_, t in parts).replace(" ", "") == text
    parts, even, short, whole = split((0, 60_000, long_), (0, 40_000, "あ" * 200), (0, 3000, "短い。"), (0, 6000, eight))
    assert len(parts) >= 8 and all(b - a <= 8000 for a, b, _ in parts)
    assert len(even) >= 5 and len(short) == 1 and len(whole) == 1
    parts, sparse, four, none = split((0, 6000, eight), (0, 20_106, "你他妈可香了"), (37_000, 51_900, crowd), (5, 9, None), chars=40)
    assert len(parts) >= 2 and all(len(t) <= 42 for *_, t in parts)
    assert [t for *_, t in sparse] == ["你他妈", "可香了"] and sparse[-1][1] == 20_106
    assert len(four) >= 3 and all(b - a <= 7500 and len(t) <= 42 for a, b, t in four)
    assert none == [(5, 9, None)]


def test_split_is_the_statement(spark):
    rng = random.Random(2)
    rows = [("s", k, k * 10, k * 10 + rng.randint(0, 30_000), "".join(rng.choice("ab ，。あ\n") for _ in range(rng.randint(0, 90)))) for k in range(300)]
    df = spark.createDataFrame(rows, "source_id string, seq int, start_ms long, end_ms long, text string")
    given = rows, ["source_id", "seq", "start_ms", "end_ms", "text"]
    for secs, chars in ((7.0, 40), (2.5, 12)):
        want = stated(f"with {statements.split_ctes('c', '(select * from given)', 'seq', secs, chars)} select * from c order by seq, piece", given=given)
        got = layout.split_long_cues(df, secs, chars).orderBy("seq", "piece").collect()
        assert [(r["seq"], r["piece"], r["start_ms"], r["end_ms"], r["text"]) for r in got] == want
        # Times: first start and last end are exact unless a piece would last under a millisecond.
        for k in range(300):
            own = [r for r in got if r["seq"] == k]
            assert own[0]["start_ms"] == rows[k][2] and all(a["end_ms"] == b["start_ms"] for a, b in zip(own, own[1:], strict=False))


def test_wrap_cases():
    s = "今日はとても良い天気なので、公園まで散歩に行くことにしました。"
    lines = layout.wrap_one(s, 30).split("\n")
    assert lines[0].endswith("、") and "".join(lines) == s
    assert layout.wrap_one("短い文", 20) == "短い文"
    assert layout.wrap_one("a" * 30, 10).split("\n") == ["a" * 10] * 3
    mixed = layout.wrap_one("これは CUDA 12.4 の ggml-cuda.dll を読み込む処理です。", 24)
    assert all(not x.endswith(" ") and sum(1 + bool(layout._WIDE.match(c)) for c in x) <= 24 for x in mixed.split("\n"))
    # A break character at the very last place that fits is passed over for an earlier one.
    assert layout.wrap_one("ab,cdef,gh", 8).split("\n")[0] == "ab,"


def test_wrap_is_the_statement(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab ，。あ,\n　;é") for _ in range(rng.randint(0, 150)))) for k in range(200)]
    want = dict(stated(f"with recursive {statements.wrap_ctes('w', '(select * from given)', 10)} select id, wrapped from w", given=(rows, ["id", "t"])))
    assert {k: layout.wrap_one(t, 10) for k, t in rows} == want


def test_layout_numbers(spark):
    out = layout.layout(cues(spark, [(0, 20_000, "とても長い文章です。まだまだ続きます。最後に終わります。"), (20_000, 22_000, "短い"), (22_000, 23_000, " ")]), 20, 7.0, 0)
    rows = out.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 3 and rows[-1]["text"] == "短い"


def test_segment_verdicts(spark):
    cases = [
        ("None", "", 5.0, False, "empty", None), ("Japanese", "   ", 5.0, True, "empty", None), ("Chinese", "……。", 5.0, False, "empty", None),
        ("Chinese", "啊！" * 56, 14.9, False, "process", "啊！啊！"), ("Chinese", " 太阳会升起。 ", 2.0, False, "process", "太阳会升起。"),
        ("None", "今天", 0.8, True, "fragment", None), ("None", "今天", 0.8, False, "process", "今天"), ("none", "谢谢大家的观看", 5.0, True, "process", "谢谢大家的观看"),
        ("None", "嗯！" * 10, 1.0, True, "fragment", None), ("Japanese", "はい", 0.5, True, "process", "はい"),
    ]
    for flag in (True, False):
        own = [c for c in cases if c[3] == flag]
        df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(own)], "i int, lang string, text string, dur double")
        got = df.select("i", dedup.segment_verdict(df.lang, df.text, df.dur, flag).alias("v")).orderBy("i").collect()
        assert [(r["v"]["verdict"], r["v"]["text"]) for r in got] == [c[4:] for c in own]


def verdicts(spark, rows):
    got = dedup.cue_verdicts(spark.createDataFrame(rows, "source_id string, seq int, piece int, text string")).collect()
    return {(r["source_id"], r["seq"]): r["verdict"] for r in got}


def test_cue_verdict_cases(spark):
    # Cases that the results must equal. Each is a source of a kept cue and the cue to be judged.
    cases = [
        ("今天天气很好。", "今天天气很好", "duplicate"), ("今天天气很好！", "明天天气很好", "keep"), ("今天天气很好。", None, "keep"),
        ("哎呀！", "太阳会升起", "keep"), ("嗯嗯。", "嗯", "filler_repeat"), ("嗯好的。", "嗯", "keep"), ("嗯。", "嗯", "duplicate"), ("……", "嗯", "empty"),
        ("我爱你，我爱你！", "我爱你我爱你", "keep"),
    ]
    got = verdicts(spark, [(str(k), i, 0, t) for k, (text, last, _) in enumerate(cases) for i, t in enumerate((last, text))])
    assert [got[str(k), 1] for k in range(len(cases))] == [c[2] for c in cases]


def test_cue_verdicts_are_the_statement(spark, monkeypatch):
    rng = random.Random(9)
    pool = ["嗯。", "嗯嗯", "啊……", "……", "好的。", "好的", "我爱你，我爱你！", "abcabc", "abc", "x", "aabaabaab", "aab", "ab" * 5, "abab", None]
    rows = [(f"s{k}", i, 0, rng.choice(pool)) for k in range(120) for i in range(12)]
    sql = f"with recursive {statements.verdict_ctes('c', '(select source_id, seq, piece, coalesce(text, chr(32)) as text from given)')} select source_id, seq, verdict from c"
    want = {(a, b): v for a, b, v in stated(sql, given=(rows, ["source_id", "seq", "piece", "text"]))}
    assert verdicts(spark, rows) == want and set(want.values()) == {"keep", "empty", "duplicate", "filler_repeat"}
    for chunk in (1, 5):  # the chunks of a source do not show
        monkeypatch.setattr(dedup, "CHUNK", chunk)
        assert verdicts(spark, rows) == want


def test_cue_verdicts_one_by_one(spark, monkeypatch):
    """Long sources, with texts whose echoes are echoes again, against a plain loop over the cues."""
    rng = random.Random(4)
    bare = echo.collapse_all
    found = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 26))) for _ in range(6000)]
    once = bare(found)
    chains = [c for c in zip(found, once, bare(once), strict=True) if len(set(c)) == 3][:12]
    assert len(chains) > 5
    pool = [*chains, ("嗯嗯嗯嗯", "嗯嗯"), ("嗯", "啊", "啊"), ("好的", "好的"), ("", "嗯", "", "嗯"), ("x",), ("abcabc", "abc", "abcabc", "abc")]
    rows = []
    for k in range(40):
        texts = []
        while len(texts) < 150:
            texts += rng.choice(pool)
            texts += [""] * rng.randint(0, 1)
        rows += [(f"s{k}" if k else None, i, 0, t) for i, t in enumerate(texts)]
    bases = dict(zip(sorted({r[3] for r in rows}), bare(sorted({r[3] for r in rows})), strict=True))
    want, base = {}, {}
    for source, seq, _, text in rows:
        last = base.get(source)
        filler = lambda t: bool(t) and set(t) <= set(X.FILLERS)
        verdict = "empty" if not text else "keep" if last is None else "duplicate" if text == last else "filler_repeat" if filler(text) and filler(last) else "keep"
        if verdict == "keep":
            base[source] = bases[text]
        want[source, seq] = verdict
    for chunk in (65_536, 40, 3):
        monkeypatch.setattr(dedup, "CHUNK", chunk)
        assert verdicts(spark, rows) == want


def test_cues_are_judged_without_python_in_a_loop(spark):
    df = spark.createDataFrame([("s", 0, 0, "x")], "source_id string, seq int, piece int, text string")
    plan = dedup.cue_verdicts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert verdicts(spark, [("s", 0, 0, None)]) == {("s", 0): "empty"}
    assert dedup.cue_verdicts(df.limit(0)).count() == 0


def test_srt(spark):
    made = srt.render(cues(spark, [(0, 1500, "第一句"), (1500, 4000, "第二句\n换行")]))
    assert made.first()["srt"].startswith("1\n00:00:00,000 --> 00:00:01,500\n第一句\n\n2\n")
    back = srt.parse(made).orderBy("index").collect()
    assert [(r["index"], r["start_ms"], r["end_ms"], r["text"]) for r in back] == [(1, 0, 1500, "第一句"), (2, 1500, 4000, "第二句\n换行")]
    text = "00:00:01,000 --> 00:00:02,000\r\n只有时间轴没有序号\r\n\r\n2\r\n00:00:03.000 --> 00:00:04.000\r\n第二条\r\n\r\nno time\n\n"
    loose = spark.createDataFrame([("f", text)], "source_id string, srt string")
    assert [(r["start_ms"], r["text"]) for r in srt.parse(loose).orderBy("index").collect()] == [(1000, "只有时间轴没有序号"), (3000, "第二条")]
    assert [r["text"] for r in srt.parse_strict(loose.selectExpr("source_id", "replace(srt, '\r', '') as srt")).collect()] == ["第二条"]


def test_srt_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nx\n\n")
    (tmp_path / "a.raw.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\ny\n\n")
    assert [r["text"] for r in srt.parse(srt.read(spark, str(tmp_path))).collect()] == ["x"]


def test_one_file_for_each_source(spark, tmp_path):
    rows = [("a b", 0, 0, 1500, "x"), ("a b", 1, 1500, 2000, "y"), ("ü=1", 0, 0, 10, "z")]
    df = spark.createDataFrame(rows, "source_id string, seq int, start_ms long, end_ms long, text string")
    for _ in range(2):  # a second run overwrites the first
        srt.write(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".srt") == ["a b.srt", "ü=1.srt"]
    assert (tmp_path / "out" / "a b.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,500\nx\n\n2\n00:00:01,500 --> 00:00:02,000\ny\n\n"
    assert len(srt.parse(srt.read(spark, str(tmp_path / "out"))).collect()) == 3
