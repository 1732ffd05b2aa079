"""Segmentation: against a statement that goes frame by frame, literal cases, the stream."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from cuewright.operators.segment import Limits, bounds_ms, cut_samples, mask, merge_pad_split, track, track_capped
from cuewright.plans.statements import capped_sql
from cuewright.streaming.segments import advance, finish, oldest_needed


def stated(lists, limits):
    """The segments of lists of scores by the engine's statement, in which every frame is a row of a recursion."""
    rows = [(k, i, p) for k, probs in enumerate(lists) for i, p in enumerate(probs)]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["source_id", "frame_idx", "prob"]))
    out = {}
    for k, a, b in con.execute(capped_sql("(select * from given)", limits)).fetchall():
        out.setdefault(k, []).append((a, b))
    return {k: sorted(v) for k, v in out.items()}


def streamed(probs, limits, seed=0):
    """The segments of one list by the stream's form, its frames arriving in pieces of random sizes."""
    rng, state, out, at = random.Random(seed), (0, -1, -1, []), [], 0
    while at < len(probs):
        n = rng.randint(1, 25)
        found, state = advance(state, np.array(probs[at : at + n]) >= limits.threshold, limits)
        out += found
        at += n
    return sorted(out + finish(state, limits))


def sequences(seed, n, min_run=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        probs = []
        while len(probs) < 120:
            probs += [0.01] * rng.randint(1, 30) + [0.9] * rng.randint(min_run, 20)
        out.append(probs[: len(probs) - rng.randint(0, 15)])
    return out


def as_frames(spark, lists):
    return spark.createDataFrame([(k, i, p) for k, probs in enumerate(lists) for i, p in enumerate(probs)], "source_id long, frame_idx long, prob double")


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["source_id"], []).append((r["start_frame"], r["end_frame"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("limits", [Limits(), Limits(min_silence=6), Limits(min_speech=2, min_silence=3, merge_gap=6, pad=2)])
def test_track_is_the_statement(spark, limits):
    lists = sequences(3, 60)
    want = stated(lists, limits)
    assert collected(track(as_frames(spark, lists), limits)) == want == collected(track_capped(as_frames(spark, lists), limits))
    assert {k: s for k, p in enumerate(lists) if (s := streamed(p, limits, k))} == want


def test_chunks_do_not_show(spark, monkeypatch):
    from cuewright.operators import segment

    lists = sequences(4, 20)
    whole = collected(track(as_frames(spark, lists)))
    monkeypatch.setattr(segment, "CHUNK", 7)
    assert collected(track(as_frames(spark, lists))) == whole


CAPPED = [
    Limits(min_speech=3, min_silence=5, merge_gap=8, pad=2, max_seg=12),
    Limits(min_speech=7, min_silence=9, merge_gap=3, pad=2, max_seg=5),
    Limits(min_speech=1, min_silence=20, merge_gap=1, pad=1, max_seg=4),
]


@pytest.mark.parametrize("limits", CAPPED)
def test_capped_is_the_statement(spark, limits, monkeypatch):
    from cuewright.operators import segment

    lists = sequences(5, 40) + [[0.9] * 77, [0.01] * 30, [0.9]]
    want = stated(lists, limits)
    assert collected(track_capped(as_frames(spark, lists), limits)) == want
    monkeypatch.setattr(segment, "CHUNK", 11)
    assert collected(track_capped(as_frames(spark, lists), limits)) == want
    assert {k: s for k, p in enumerate(lists) if (s := streamed(p, limits, k))} == want


def test_capped_literal_cases(spark):
    limits = Limits(min_speech=2, min_silence=3, merge_gap=5, pad=0, max_seg=4)
    on, off = [0.9], [0.0]
    lists = [
        on * 5,  # the fifth frame is on the cap and ends a segment of five
        on * 6 + off * 10,  # one frame is left over, too short to be kept
        on * 3 + off * 4 + on * 3 + off * 9,  # taken up again after the cap: the second frame after cuts
        on * 3 + off * 5 + on * 3 + off * 9,  # a gap of merge_gap frames is not bridged
        off * 2 + on * 2 + off * 2,  # the stream ends before the silence is long enough
    ]
    assert collected(track_capped(as_frames(spark, lists), limits)) == {0: [(0, 5)], 1: [(0, 5)], 2: [(0, 9)], 3: [(0, 3), (8, 11)], 4: [(2, 6)]}


def test_batch_equals_stream_when_runs_are_long(spark):
    limits = Limits(min_speech=8, min_silence=15, merge_gap=12)
    lists = sequences(6, 40, min_run=8)
    f = as_frames(spark, lists)
    assert collected(merge_pad_split(mask(f, limits), limits)) == collected(track(f, limits))


def test_literal_cases(spark):
    probs = [0.01] * 30
    probs[5:10] = [0.9] * 5
    probs[15:25] = [0.8] * 10
    two = [0.01] * 20
    two[7] = 0.9
    found = collected(mask(as_frames(spark, [probs, two]), Limits(min_speech=2, min_silence=3)).drop("n_frames"))
    assert found == {0: [(5, 10), (15, 25)]}
    segs = spark.createDataFrame([(0, 5, 10, 100), (0, 12, 20, 100)], "source_id long, start_frame long, end_frame long, n_frames long")
    assert collected(merge_pad_split(segs, Limits(merge_gap=12, pad=3, max_seg=27))) == {0: [(2, 23)]}
    assert collected(merge_pad_split(segs, Limits(merge_gap=12, pad=3, max_seg=10))) == {0: [(2, 9), (9, 16), (16, 23)]}


def test_hard_split_waits_for_its_padding():
    limits = Limits(min_speech=4, min_silence=10, max_seg=20, merge_gap=5, pad=3)
    found, state = advance((0, -1, -1, []), np.ones(23, dtype=bool), limits)
    assert not found and oldest_needed(state, limits) == 0
    found, state = advance(state, np.ones(1, dtype=bool), limits)
    assert found == [(0, 24)] and oldest_needed(state, limits) == 18
    assert oldest_needed((5, -1, -1, []), limits) is None
    got = streamed([0.9] * 280, Limits(min_speech=8, max_seg=50))
    assert got[0][0] == 0 and got[-1][1] == 280 and all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))


def test_cut_samples(spark):
    segs = spark.createDataFrame([(1, 1, 3), (1, 3, 9)], "source_id long, start_frame long, end_frame long")
    audio = spark.createDataFrame([(1, [float(x) for x in range(9)])], "source_id long, samples array<float>")
    got = {r["start_sample"]: r["samples"] for r in cut_samples(segs, audio, 2).collect()}
    assert got == {2: [2.0, 3.0, 4.0, 5.0], 6: [6.0, 7.0, 8.0]}


def test_bounds_ms_floor(spark):
    segs = spark.createDataFrame([(1, 3, 7)], "source_id long, start_frame long, end_frame long")
    assert bounds_ms(segs).first()["start_ms"] == 3 * 512 * 1000 // 16000


def test_empty(spark):
    f = spark.createDataFrame([], "source_id long, frame_idx long, prob double")
    assert track(f).count() == 0
    assert track_capped(f, Limits(max_seg=5)).count() == 0


def test_stream(spark, tmp_path):
    from cuewright.streaming.segments import session_segments, tracked_segments

    lists = sequences(8, 4)
    as_frames(spark, lists).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("source_id long, frame_idx long, prob double").parquet(str(tmp_path / "in"))
    limits = Limits(min_speech=3, min_silence=5, merge_gap=8, pad=2, max_seg=12)
    q = tracked_segments(read, limits).writeStream.format("memory").queryName("capped").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = collected(spark.table("capped"))
    for k, probs in enumerate(lists):
        want = streamed(probs, limits)
        assert [s for s in want if s in got.get(k, [])] == got.get(k, [])
        assert len(want) - len(got.get(k, [])) <= 2  # what is open at the stream's end
    q = session_segments(read, Limits(), "0 seconds").writeStream.format("memory").queryName("plain").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = collected(spark.table("plain"))
    # In a stream the last run ends at its last speech frame, as if silence went on.
    assert closed and all(s in streamed(lists[k] + [0.01] * 60, Limits()) for k, v in closed.items() for s in v)


@pytest.mark.parametrize("piece", [7, 40, 1000])
def test_samples_of_a_stream(spark, tmp_path, piece):
    """The segments' samples are those of the table's form for any size of batch; what no segment needs is dropped."""
    from cuewright.streaming.segments import STATE_STORE, cut_stream

    limits = Limits(min_speech=3, min_silence=5, merge_gap=8, pad=2, max_seg=12)
    lists = [p[:70] for p in sequences(12, 3)]
    samples = lambda k, i: [float(1000 * k + 2 * i), float(1000 * k + 2 * i + 1)]
    schema = "source_id long, frame_idx long, prob double, samples array<float>"
    rows = [(k, i, p, samples(k, i)) for k, probs in enumerate(lists) for i, p in enumerate(probs)]
    ends = [(k, len(probs), None, None) for k, probs in enumerate(lists)]
    for n, at in enumerate(range(0, 71, piece)):
        part = [r for r in rows + ends if at <= r[1] < at + piece]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert n < 100
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"cut_{piece}"
        q = cut_stream(read, limits, frame_samples=2).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    audio = spark.createDataFrame([(k, b, [x for i in range(16 * b, min(16 * b + 16, len(p))) for x in samples(k, i)]) for k, p in enumerate(lists) for b in range(-(-len(p) // 16))], "source_id long, block long, samples array<float>")
    frames = as_frames(spark, lists)
    want = sorted(map(tuple, cut_samples(track_capped(frames, limits), audio, 2, 32).collect()))
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == want and len(want) > 5
    held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    most = limits.max_seg + limits.min_silence + limits.merge_gap + 2 * limits.pad + 1
    assert held[-1] == 0 and (piece == 1000 or max(held) <= len(lists) * (most + 4))  # frames, and a few rows for a source


def test_a_long_run_is_linear(spark):
    """A million frames without a break in one source; and the plan reads its input as often as the frames are numbered."""
    import time

    from pyspark.sql import functions as F

    from cuewright.plans import registry

    f = spark.range(1_000_000).select(F.lit(1).alias("source_id"), F.col("id").alias("frame_idx"), F.when(F.col("id") % 4 < 3, 0.9).otherwise(0.1).alias("prob"))
    began = time.perf_counter()
    assert track_capped(f, Limits(max_seg=8)).count() > 90_000 and time.perf_counter() - began < 20
    for name in ("vad_capped", "vad_segments", "vad_batch", "vad_cut"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("FileScan") <= 4
