"""Training sets, readers, quality metrics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import twister
from cuewright.operators import corpus, quality
from cuewright.sources import corpus as sources
from cuewright.sources import files, models, srt


def test_lookup(spark):
    table = spark.createDataFrame([("a。", "A1", 0), ("b", "B", 1), ("a", "A2", 2), ("b", "B2", 3)], "src string, dst string, line_no long")
    rows = spark.createDataFrame([(1, " a "), (2, "a！"), (3, "b"), (4, "c"), (5, None)], "i int, text string")
    got = {r["i"]: (r["target"], r["match"]) for r in corpus.translate(rows, table).collect()}
    # The loose key takes the first line of the table: "a。".
    assert got == {1: ("A2", "exact"), 2: ("A1", "loose"), 3: ("B2", "exact"), 4: (None, "miss"), 5: (None, "miss")}
    assert {r["i"] for r in corpus.missing(rows, table).collect()} == {2, 4, 5}


def test_transcripts_and_duration(spark):
    files = spark.createDataFrame([("/w/a.wav", 0.5), ("/w/b.wav", 2.0), ("/w/c.wav", 9.0)], "path string, secs double")
    keys = spark.createDataFrame([("a", "x"), ("b.wav", "y"), ("b", "")], "key string, text string")
    got = {r["path"]: r["text"] for r in corpus.join_transcripts(files, keys).collect()}
    assert got == {"/w/a.wav": "x", "/w/b.wav": "y"}
    assert corpus.within_duration(files, 9.0).count() == 2 and corpus.within_duration(files, 9.0, None).count() == 3


def test_labelled_text_and_channel_mean(spark):
    rows = spark.createDataFrame([(1, " a\u3000", "raw"), (2, None, "\traw "), (3, "", "raw"), (4, " ", "raw"), (5, None, None), (6, "", "")], "i int, transcription string, raw_transcription string")
    assert {r["i"]: r["text"] for r in corpus.labelled_text(rows).collect()} == {1: "a", 2: "raw", 3: "raw"}
    files = spark.createDataFrame([("mono", [0.5, -1.0], 1), ("two", [1.0, 0.0, 0.5, 0.25, 9.0], 2), ("none", [], 2)], "source_id string, samples array<float>, channels int")
    assert {r["source_id"]: r["samples"] for r in sources.channel_mean(files).collect()} == {"mono": [0.5, -1.0], "two": [0.5, 0.375], "none": []}


def test_records_and_silence(spark):
    rows = corpus.position(spark.range(50).select((F.col("id") * 7).alias("row_id"), F.lit("t").alias("text"), F.when(F.col("id") != 49, "z").alias("target"), F.lit("f").alias("audio")), ["row_id"])
    assert sorted(r["position"] for r in rows.collect()) == list(range(50))
    made = corpus.records(rows, 40, 0.3, 7, "p").collect()
    assert len([r for r in made if r["split"] == "eval"]) == 18  # the row without a target is skipped
    assert len([r for r in made if r["split"] == "train"]) == 40
    assert {(r["task"], r["prompt"]) for r in made} == {("translate", "p"), ("transcribe", "")}
    s = corpus.silence_rows(spark, 8, "p", 0.5, 5, 1).orderBy("j").collect()
    assert [(r["zeros"], r["prompt"] == "p") for r in s[:4]] == [(True, True), (False, True), (True, False), (False, False)]
    assert [r["secs"] for r in s[:4]] == [2.0] * 4 and all(0.5 <= r["secs"] <= 5 for r in s)


@pytest.mark.parametrize("seed", [42, 0, 2**40 + 7])
def test_draws_are_the_generators(spark, seed):
    """Any partitioning and order of the rows, any size of block, gaps in the positions."""
    plain = random.Random(seed)
    want = [plain.random() for _ in range(3000)]
    rows = spark.range(3000).select(F.col("id").alias("position"), F.lit("x").alias("text")).where("position % 7 <> 3")
    for n, block in ((1, 100), (5, 256), (9, 65_536)):
        got = corpus.with_draws(rows.repartition(n), seed, block).collect()
        assert len(got) == rows.count() and all(r["draw"] == want[r["position"]] and r["text"] == "x" for r in got)
    assert corpus.with_draws(rows.limit(0), seed).count() == 0


def test_draws_far_ahead():
    plain = random.Random(5)
    for _ in range(11 * 65_536):
        plain.random()
    state, ahead = twister.seeded(5), twister.leaps()
    assert twister.block_draws(state, 11, ahead)[:50].tolist() == [plain.random() for _ in range(50)]
    # One leap of 2**40 blocks is two of 2**39, and leaps commute.
    far = twister.moved(twister.moved(state, ahead[39]), ahead[39])
    assert (far[1:] == twister.moved(state, ahead[40])[1:]).all()
    assert (twister.moved(twister.moved(state, ahead[3]), ahead[20])[1:] == twister.moved(twister.moved(state, ahead[20]), ahead[3])[1:]).all()
    assert twister.polynomial().bit_length() == twister.DEGREE + 1


def test_readers(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# note\n\na\tb\tc\n \tx\na\td\nno tab\n")
    pairs = sources.parallel_pairs(sources.numbered_lines(spark, str(tmp_path / "p.tsv")))
    assert [(r["src"], r["dst"]) for r in corpus.last_wins(pairs).collect()] == [("a", "d")]
    lines = spark.createDataFrame([(0, '{"k": "1", "v": "a"}'), (1, ""), (2, '{"k": "1", "v": "b"}')], "line_no long, line string")
    assert [tuple(r) for r in sources.cache(lines).collect()] == [("1", "b")]
    (tmp_path / "r.jsonl").write_text('{"audio": "f", "text": "é", "prompt": ""}\n\n')
    assert sources.read_records(spark, str(tmp_path / "r.jsonl")).count() == 1
    sources.write_records(sources.read_records(spark, str(tmp_path / "r.jsonl")), str(tmp_path / "out"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    (tmp_path / "a.pcm").write_bytes(b"\0\0\x80?\0\0\0@\1\2")
    assert files.read_pcm(spark, str(tmp_path / "a.pcm")).first()["samples"] == [1.0, 2.0]
    assert sources.pcm_samples(spark.createDataFrame([("a", b"\0\0\x80?\0\0\0@\1\2")], "path string, content binary")).first()["samples"] == [1.0, 2.0]
    layout = spark.createDataFrame([("w", 0, 10, [2, 5]), ("b", 40, 5, [5])], "name string, offset long, len long, shape array<int>")
    assert [r["ok"] for r in sources.weight_layout(layout, 15, ("w",)).orderBy("offset").collect()] == [True, True]
    with pytest.raises(ValueError, match="b"):
        sources.weight_layout(layout, 12, ("w", "b"))
    taken = spark.createDataFrame([("x",)], "id string")
    assert [r["id"] for r in sources.untaken(spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, r int"), taken, "id", "r", 1).collect()] == ["y"]


def test_models(spark, tmp_path):
    folders = full, half, gone = [tmp_path / n for n in ("full", "half", "gone")]
    full.mkdir(), half.mkdir()
    make = lambda p: p.write_bytes(b"x")
    find = lambda *f, **more: models.resolve(spark, [str(x) for x in f], **more)
    make(half / "a.gguf")
    with pytest.raises(ValueError, match="no model"):
        find(half, gone)
    for n in ("q.gguf", "mmproj-q.gguf", "notes.txt"):
        make(full / n)
    assert find(gone, half, full).language.endswith("full/q.gguf") and find(full).audio.endswith("full/mmproj-q.gguf")
    assert find(half, language=str(full / "own.bin")) == models.Model(str(full / "own.bin"), find(full).audio)
    assert find(gone, audio=str(half / "x")).language.endswith("half/a.gguf") and find(audio="x", language="y") == models.Model("y", "x")
    make(full / "z.gguf")
    with pytest.raises(ValueError, match="more than one language model"):
        find(*folders)
    make(half / "mmproj.gguf")
    make(half / "mmproj-2.gguf")
    assert find(full, half).audio.endswith("half/mmproj.gguf")  # a folder's error counts only if none is complete
    make(full / "model.gguf")
    assert find(full).language.endswith("full/model.gguf")
    make(full / "mmproj-z.gguf")
    with pytest.raises(ValueError, match="more than one audio model"):
        find(full, gone)


def test_bad_files_and_lines_are_rows(spark, tmp_path):
    good = b"1\n00:00:00,000 --> 00:00:01,000\nx\n\n"
    for name, raw in {"a.srt": good, "b.srt": b"\xc3\x28", "c.srt": b"\n", "d.srt": good, "d.raw.srt": good}.items():
        (tmp_path / name).write_bytes(raw)
    rows, seen = sources.watched(srt.read_each(spark, str(tmp_path)), "files")
    got = {r["source_id"][-5:]: (r["srt"], r["error"]) for r in rows.collect()}
    assert got == {"a.srt": (good.decode(), None), "b.srt": (None, "not UTF-8"), "c.srt": (None, "no time line"), "d.srt": (good.decode(), None)}
    assert seen.get == {"n_rows": 4, "n_errors": 2}
    (tmp_path / "r.jsonl").write_text('{"audio": "f", "text": "t", "prompt": ""}\nnot json\n{"audio": 1}\n')
    got = [tuple(r) for r in sources.read_each_record(spark, str(tmp_path / "r.jsonl")).collect()]
    assert got == [("f", "t", "", None), (None, None, None, "not json"), ("1", None, None, None)]


def test_metrics(spark):
    cues = spark.createDataFrame([("s", 0.0, 2.0, "你好\n世界"), ("s", 2.0, 20.0, "あ")], "source_id string, start_s double, end_s double, text string")
    m = quality.subtitle_metrics(cues).first()
    assert (m["n_cues"], m["kana"], m["cjk"], m["widest"], m["longest"], m["most_chars"], m["n_skinny"]) == (2, 0.2, 0.8, 4, 18.0, 4, 1)
    ok = {r["check"]: r["ok"] for r in quality.subtitle_checks(quality.subtitle_metrics(cues)).collect()}
    assert ok == {"density": True, "kana": False, "cjk": True, "width": True, "longest": False, "chars": True, "skinny": False}
    rows = spark.createDataFrame([("g", "p", "你"), ("g", "", "あ"), ("g", None, "ab")], "g string, prompt string, out string")
    e = quality.eval_checks(quality.eval_metrics(rows, ["g"])).first()
    assert (e["translated_kana"], e["transcribed_kana"], e["leaks"], e["translation_takes_effect"]) == (0.0, 0.5, 1, True)
    assert quality.silence_check(spark.createDataFrame([("", None), ("a b", None)], "text string, error string")).first()[0] is False


def test_log_checks(spark):
    lines = spark.createDataFrame([("f", "x load_tensors y"), ("f", ""), ("f", "转录完成：3 段语音 → 5 条字幕"), ("f", "已写出字幕")], "source_id string, line string")
    assert [tuple(r) for r in quality.noise_hits(lines).collect()] == [("f", "load_tensors", 1)]
    assert {r["marker"]: r["found"] for r in quality.required_markers(lines).collect()} == {"已写出字幕": True, "转录完成": True, "[ASR✔": False}
    cap = quality.line_cap(lines).first()
    assert (cap["n_lines"], cap["n_files"], cap["n_kept"], cap["cap"], cap["ok"]) == (3, 1, 5, 17, True)
    assert json.loads(sources.report_json(quality.line_cap(lines)).first()["json"])["cap"] == 17


def test_silence_joins_the_training_part(spark):
    rows = spark.createDataFrame([(k, "t", "z" if k % 2 else None, "f", k) for k in range(40)], "row_id long, text string, target string, audio string, position long")
    made = corpus.with_silence(corpus.records(rows, 30, 0.3, 7, "p"), corpus.silence_rows(spark, 6, "p", 0.5, 2.0, 7))
    n = {(r["split"], r["task"]): r["n"] for r in corpus.composition(made).collect()}
    counts = corpus.counters(rows, 30, 0.3, 7, 6).first()
    assert n["train", "silence"] == counts["n_silence"] == 6 and made.where("task = 'silence' and row_id is null").count() == 6
    assert (n["train", "translate"] + n["eval", "translate"], n["train", "transcribe"]) == (counts["n_mt"], counts["n_asr"])
    assert counts["n_mt"] + counts["n_asr"] + counts["n_skipped"] == 40


def test_report_rounds_as_decimals_do(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    values = [k / 3 for k in range(50)] + [0.00005, 0.00015, 0.12345, 2.67485, 0.03125] + [k / 32 / 1000 for k in range(60)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(quality.rounded("v")).collect()]
    assert got == [float(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) for v in values]
    rows = spark.createDataFrame([("", "あ亜亜"), ("", "あああ亜亜亜亜"), ("p", "亜")], "prompt string, out string").selectExpr("'g' g", "*")
    report = quality.eval_metrics(rows, ["g"], report=True).first()
    assert report["transcribed_kana"] == round((0.3333 + 0.4286) / 2, 4) and report["translated_kana"] == 0.0 and report["leaks"] == 0


def test_first_match_and_first_rows(spark):
    rows = spark.createDataFrame([("a", "x", 2, True), ("a", "y", 1, False), ("a", "z", 3, True), ("b", "w", 1, False)], "g string, v string, r int, ok boolean")
    assert {r["g"]: r["first"] for r in corpus.first_match(rows, "g", "v", "r", F.col("ok")).collect()} == {"a": "x", "b": None}
    assert [r["v"] for r in corpus.first_rows(rows, ["r", "v"], 2).collect()] == ["w", "y"]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 7) if k % 5 else "" for k in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\r\ntwo")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sources.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    by = {}
    for r in got:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], r["line"]))
    assert sorted(by["a.txt"]) == list(enumerate(lines)) and sorted(by["b.txt"]) == [(0, "one"), (1, "two")]
