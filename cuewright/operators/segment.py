"""Segmentation of per-frame scores: hysteresis, gap merging, length limits, padding.

Frames are ``(source_id, frame_idx, prob)`` with ``frame_idx`` counting from 0 in each source.
Segments are ``(source_id, start_frame, end_frame)``, half open.

Speech frames in a row are a streak. A silence that ends a segment whatever came before it is a break: what follows does
not depend on what was open. A source is cut into chunks of frames, and each chunk is worked on by itself: behind its first
break all is known there. Only the streaks before that break and the segment that is open behind the last streak go on to one pass
over a source's chunks in order, which carries two numbers from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
FRAME_SAMPLES = 512
SAMPLE_RATE = 16_000


@dataclass(frozen=True)
class Limits:
    """Thresholds in frames; ``max_seg`` 0 means no cap."""

    threshold: float = 0.5
    min_speech: int = 7
    min_silence: int = 15
    merge_gap: int = 12
    pad: int = 3
    max_seg: int = 0


Span = tuple[int, int]


def left_at(a: int, e: int, limits: Limits) -> int:
    """The silent frame at which a segment from ``a`` whose speech ended at ``e`` is left, if the silence lasts."""
    quiet = e + limits.min_silence - 1
    return min(quiet, max(e, a + limits.max_seg)) if limits.max_seg else quiet


def follow(a: int, e: int, streaks: Iterable[Span], limits: Limits, out: list[Span]) -> Span:
    """The open segment, from ``a`` with speech up to ``e`` (-1: none), behind further ``streaks``; segments that are over go to ``out``.

    A segment is left in a silence once that has ``min_silence`` frames or the segment's cap is reached, and
    taken up again by speech that follows within ``merge_gap``. Speech on or past the cap cuts the segment
    behind its frame, so a streak is cut every ``max_seg + 1`` frames from its first cut on; the frame by
    which a segment begins or is taken up again never cuts. A streak may come in pieces.
    """
    cap, least = limits.max_seg, max(1, limits.min_speech)
    for start, end in streaks:
        left = a < 0 or left_at(a, e, limits) < start
        if a < 0 or (left and start >= e + limits.merge_gap):
            if a >= 0 and e - a >= least:
                out.append((a, e))
            a = start
        if cap:
            for at in range(max(start + left, a + cap), end, cap + 1):
                out.append((a, at + 1))
                a = at + 1
        e = end
    return a, e


def streaks_of(speech: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frames and ends of the streaks of sorted speech frames."""
    if not len(speech):
        return speech, speech
    new = np.flatnonzero(np.diff(speech) > 1) + 1
    return speech[np.concatenate([[0], new])], speech[np.concatenate([new - 1, [len(speech) - 1]])] + 1


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _in_chunks(frames: DataFrame, limits: Limits) -> DataFrame:
    """A row for each chunk of each source: ``head``, the streaks before its first break; ``body``, the segments that are over
    behind it; ``a, e``, the segment that is open at the end, null without a break; and the source's ``n_frames``."""
    at = F.col("frame_idx").cast("long")
    chunks = frames.groupBy("source_id", F.floor(at / CHUNK).alias("chunk")).agg(
        F.max(at).alias("last"), F.sort_array(F.collect_list(F.when(F.col("prob") >= limits.threshold, at))).alias("speech")
    )
    gap = max(limits.min_silence, limits.merge_gap)
    kind = frames.schema["source_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            lists = batch.column("speech")
            frames_, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for speech in np.split(frames_, ends[:-1]):
                begin, end = streaks_of(speech)
                breaks = np.flatnonzero(begin[1:] - end[:-1] >= gap) + 1
                first = int(breaks[0]) if len(breaks) else len(begin)
                spans = list(zip(begin.tolist(), end.tolist(), strict=True))
                body: list[Span] = []
                a, e = follow(-1, -1, spans[first:], limits, body) if len(breaks) else (None, None)
                made.append((spans[:first], body, a, e))
            head, body, a, e = ([m[i] for m in made] for i in range(4))
            spans_of = lambda x: pa.array([[{"s": s, "e": t} for s, t in y] for y in x], _SPANS)
            columns = [batch.column("source_id"), batch.column("chunk"), batch.column("last"), spans_of(head), spans_of(body), pa.array(a, pa.int64()), pa.array(e, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["source_id", "chunk", "last", "head", "body", "a", "e"])

    spans = "array<struct<s:bigint,e:bigint>>"
    known = chunks.mapInArrow(run, f"source_id {kind}, chunk long, last long, head {spans}, body {spans}, a long, e long")
    whole = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.withColumn("n_frames", F.max("last").over(whole) + 1)


def _tracked(frames: DataFrame, limits: Limits) -> DataFrame:
    """The tracker's segments without padding, with their source's ``n_frames``. A segment that is not left when its source
    ends lasts to the end."""
    kind = frames.schema["source_id"].dataType.simpleString()
    least = max(1, limits.min_speech)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, n, a, e = None, None, -1, -1

        def last() -> list[Span]:
            end = n if left_at(a, e, limits) >= n else e
            return [(a, end)] if a >= 0 and end - a >= least else []

        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                if n is None or row["source_id"] != source:
                    rows += [(source, *x, n) for x in (last() if n is not None else [])]
                    source, n, a, e = row["source_id"], row["n_frames"], -1, -1
                out: list[Span] = []
                a, e = follow(a, e, ((x["s"], x["e"]) for x in row["head"]), limits, out)
                if row["a"] is not None:
                    if e - a >= least:
                        out.append((a, e))
                    out += [(x["s"], x["e"]) for x in row["body"]]
                    a, e = row["a"], row["e"]
                rows += [(source, *x, n) for x in out]
            yield _segments(rows, batch.schema.field("source_id").type)
        if n is not None:
            yield _segments([(source, *x, n) for x in last()], batch.schema.field("source_id").type)

    ordered = _in_chunks(frames, limits).sortWithinPartitions("source_id", "chunk")
    return ordered.select("source_id", "n_frames", "head", "body", "a", "e").mapInArrow(run, f"source_id {kind}, start_frame long, end_frame long, n_frames long")


def _segments(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, names=["source_id", "start_frame", "end_frame", "n_frames"])


def padded(segments: DataFrame, pad: int) -> DataFrame:
    """Both ends moved out by ``pad``, within the source's frames."""
    return segments.withColumns({"start_frame": F.greatest(F.col("start_frame") - pad, F.lit(0)), "end_frame": F.least(F.col("end_frame") + pad, F.col("n_frames"))})


def track(frames: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The tracker without a cap; segments shorter than ``min_speech`` after merging go."""
    return track_capped(frames, replace(limits, max_seg=0))


def track_capped(frames: DataFrame, limits: Limits) -> DataFrame:
    """The tracker, with a cap unless ``max_seg`` is 0. Linear in the frames; a source's chunks are worked on apart, but for
    speech that no break ends over several chunks, which one task follows streak by streak."""
    return padded(_tracked(frames, limits), limits.pad).drop("n_frames")


def mask(frames: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The batch variant's first step: runs that end at ``min_silence``; short ones go before any merge.
    Keeps ``n_frames``."""
    return _tracked(frames, replace(limits, merge_gap=0, max_seg=0))


def merge_pad_split(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The batch variant's second step over ``source_id, start_frame, end_frame, n_frames``: merge over gaps
    under ``merge_gap``, pad, and cut what is longer than ``max_seg`` into equal parts, the last with the rest."""
    w = Window.partitionBy("source_id").orderBy("start_frame")
    reached = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = reached.isNull() | (F.greatest(F.col("start_frame") - reached, F.lit(0)) >= limits.merge_gap)
    run = segments.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(w))
    merged = run.groupBy("source_id", "run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.max("n_frames").alias("n_frames"))
    out = padded(merged, limits.pad)
    if not limits.max_seg:
        return out.select("source_id", "start_frame", "end_frame")
    out = out.withColumn("dur", F.col("end_frame") - F.col("start_frame"))
    out = out.withColumn("n", F.when(F.col("dur") > limits.max_seg, F.expr(f"dur div {limits.max_seg} + 1")).otherwise(F.lit(1)))
    out = out.withColumn("step", F.expr("dur div n")).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    start = F.col("start_frame") + F.col("k") * F.col("step")
    end = F.when(F.col("k") + 1 == F.col("n"), F.col("end_frame")).otherwise(F.col("start_frame") + (F.col("k") + 1) * F.col("step"))
    return out.select("source_id", start.alias("start_frame"), end.alias("end_frame"))


def bounds_ms(segments: DataFrame) -> DataFrame:
    """Start and end in milliseconds, by whole samples: ``sample * 1000 div rate``."""
    ms = lambda c: F.expr(f"({c} * {FRAME_SAMPLES}) * 1000 div {SAMPLE_RATE}")
    return segments.withColumns({"start_ms": ms("start_frame"), "end_ms": ms("end_frame")})


def cut_samples(segments: DataFrame, audio: DataFrame, frame_samples: int = FRAME_SAMPLES, block_samples: int | None = None) -> DataFrame:
    """Each segment's samples out of ``audio(source_id, block, samples array)``, blocks of ``block_samples`` counted from 0,
    the last of a source with the rest. A segment meets the blocks that it overlaps, so no row holds a source. Without
    ``block_samples`` a source is one row of ``audio(source_id, samples)``."""
    if block_samples is None:
        audio, block_samples = audio.withColumn("block", F.lit(0).cast("long")), 1 << 40
    start, end = F.col("start_frame") * frame_samples, F.col("end_frame") * frame_samples
    first, last = F.expr(f"(start_frame * {frame_samples}) div {block_samples}"), F.expr(f"greatest(end_frame * {frame_samples} - 1, start_frame * {frame_samples}) div {block_samples}")
    met = segments.withColumn("block", F.explode(F.sequence(first, last))).join(audio.select("source_id", "block", "samples"), ["source_id", "block"], "left")
    a = F.greatest(start - F.col("block") * block_samples, F.lit(0))
    z = F.least(end - F.col("block") * block_samples, F.size("samples"))
    piece = F.slice("samples", (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))
    pieces = met.groupBy("source_id", "start_frame", "end_frame").agg(F.array_sort(F.collect_list(F.struct("block", piece.alias("piece")))).alias("x"))
    own = F.flatten(F.filter(F.col("x.piece"), lambda p: p.isNotNull()))
    return pieces.select("source_id", "start_frame", "end_frame", start.alias("start_sample"), own.alias("samples"))


def sessions(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """Segmentation by event time: a session ends ``gap_ms`` after its last event; sessions that touch merge."""
    s = F.session_window(ts, f"{gap_ms} milliseconds")
    return events.groupBy(key, s.alias("s")).agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("s")
