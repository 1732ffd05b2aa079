"""Segmentation of frame streams under Structured Streaming.

A stream has no known end, so a run stays open until the watermark passes and then ends at its last
speech frame: trailing silence is not added, unlike in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuewright.operators.segment import FRAME_SAMPLES, Limits, Span, follow, left_at, streaks_of

FRAME_MS = 32


def session_segments(frames: DataFrame, limits: Limits = Limits(), delay: str = "10 seconds") -> DataFrame:
    """Runs of speech without a cap: ``frames(source_id, frame_idx, prob)`` on a stream, with event time from the
    frame's number. Runs are appended once the watermark has passed them."""
    gap = max(limits.min_silence, limits.merge_gap) * FRAME_MS
    timed = frames.withColumn("ts", F.timestamp_millis(F.col("frame_idx") * FRAME_MS)).withWatermark("ts", delay)
    speech = timed.where(F.col("prob") >= limits.threshold)
    runs = speech.groupBy("source_id", F.session_window("ts", f"{gap} milliseconds")).agg(
        F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_frame")
    )
    kept = runs.where(F.col("end_frame") - F.col("start_frame") >= limits.min_speech)
    return kept.select("source_id", F.greatest(F.col("start_frame") - limits.pad, F.lit(0)).alias("start_frame"), (F.col("end_frame") + limits.pad).alias("end_frame"))


_STATE = "seen long, a long, e long, waiting array<array<long>>"
State = tuple[int, int, int, list[Span]]  # frames seen, the open segment's start and end of speech (-1: none), segments whose padding is to come


def advance(state: State, speech: np.ndarray, limits: Limits) -> tuple[list[Span], State]:
    """The segments that the next frames of a source confirm, padded, and the state after them.

    The rules are those of the batch form; a streak that goes on in the next frames is one without a silence before it.
    A segment is given out when its right padding has been seen.
    """
    seen, a, e, waiting = state
    waiting = list(waiting)
    begin, end = streaks_of(np.flatnonzero(speech) + seen)
    a, e = follow(a, e, zip(begin.tolist(), end.tolist(), strict=True), limits, waiting)
    seen += len(speech)
    if a >= 0 and left_at(a, e, limits) < seen and seen >= e + limits.merge_gap:
        if e - a >= max(1, limits.min_speech):
            waiting.append((a, e))
        a = e = -1
    ready = [(max(0, x - limits.pad), y + limits.pad) for x, y in waiting if y + limits.pad <= seen]
    return ready, (seen, a, e, [w for w in waiting if w[1] + limits.pad > seen])


def finish(state: State, limits: Limits) -> list[Span]:
    """What is left at the end of a source: an open segment lasts to the end unless its silence has already ended it."""
    seen, a, e, waiting = state
    if a >= 0:
        end = e if left_at(a, e, limits) < seen else seen
        waiting = [*waiting, (a, end)] if end - a >= max(1, limits.min_speech) else waiting
    return sorted((max(0, x - limits.pad), min(y + limits.pad, seen)) for x, y in waiting)


def oldest_needed(state: State, limits: Limits) -> int | None:
    """The first frame whose samples are still needed, if any; what is before may be dropped."""
    starts = [x for x, _ in state[3]] + [state[1]] * (state[1] >= 0)
    return max(0, min(starts) - limits.pad) if starts else None


def tracked_segments(frames: DataFrame, limits: Limits, idle_ms: int = 60_000) -> DataFrame:
    """The tracker with a cap over a stream whose frames of a source arrive in order: the state of a source
    is a few numbers. A source without frames for ``idle_ms`` is at its end and its open segment is closed."""
    kind = frames.schema["source_id"].dataType.simpleString()
    columns = ["source_id", "start_frame", "end_frame"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: State = (0, -1, -1, [])
        if state.exists:
            seen, a, e, waiting = state.get
            held = (seen, a, e, [(int(x), int(y)) for x, y in waiting])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *s) for s in finish(held, limits)], columns=columns)
            return
        arrived = pd.concat(list(batches)).sort_values("frame_idx")
        found, (seen, a, e, waiting) = advance(held, (arrived["prob"] >= limits.threshold).to_numpy(), limits)
        state.update((seen, a, e, [list(w) for w in waiting]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, *s) for s in found], columns=columns)

    return frames.groupBy("source_id").applyInPandasWithState(
        step, f"source_id {kind}, start_frame long, end_frame long", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = _STATE + ", kept long"  # the first frame whose samples are held
STRETCH = 256  # frames in a map entry, at most


class _Cutter(StatefulProcessor):
    """The tracker of a source with the samples of the frames that a segment may still need, a map entry for each stretch of them.

    A batch's samples stay with the batch; of these, only the frames from ``oldest_needed`` on are held after it, and of the stretches held
    before, those that lie wholly before are dropped. Where nothing is open, the padding of a segment that may begin next is held."""

    def __init__(self, limits: Limits, idle_ms: int | None, frame_samples: int):
        self.limits, self.idle_ms, self.frame_samples = limits, idle_ms, frame_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.samples = handle.getMapState("samples", "frame long", "samples array<array<float>>")

    def _state(self) -> tuple[State, int]:
        if not self.held.exists():
            return (0, -1, -1, []), 0
        seen, a, e, waiting, kept = self.held.get()
        return (seen, a, e, [(int(x), int(y)) for x, y in waiting]), kept

    def _stretches(self) -> dict[int, list[list[float]]]:
        """The samples held, by the first frame of their stretch."""
        return {int(k[0]): v[0] for k, v in self.samples.iterator()}

    def _cut(self, key: tuple, spans: list[Span], frames: dict[int, list[float]]) -> pd.DataFrame:
        rows = []
        for start, end in spans:
            own = [np.asarray(frames[k], "float32") for k in range(start, end) if k in frames]
            rows.append((*key, start, end, start * self.frame_samples, np.concatenate(own).tolist() if own else []))
        return pd.DataFrame(rows, columns=["source_id", "start_frame", "end_frame", "start_sample", "samples"])

    def _end(self, key: tuple, state: State, frames: dict[int, list[float]]) -> pd.DataFrame:
        out = self._cut(key, finish(state, self.limits), frames)
        if self.held.exists():
            self.held.clear()
            self.samples.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        state, kept = self._state()
        stretches = self._stretches() if state[0] else {}
        arrived = pd.concat(list(rows)).sort_values("frame_idx")
        speech = arrived[arrived["prob"].notna()]
        new = dict(zip(speech["frame_idx"].tolist(), speech["samples"], strict=True))
        frames = {first + i: x for first, held in stretches.items() for i, x in enumerate(held)} | new
        found, state = advance(state, (speech["prob"] >= self.limits.threshold).to_numpy(), self.limits)
        yield self._cut(key, found, frames)
        if len(speech) < len(arrived):
            yield self._end(key, state, frames)
            return
        seen, a, e, waiting = state
        need = oldest_needed(state, self.limits)
        need = max(kept, max(0, seen - self.limits.pad) if need is None else need)
        for first, held in stretches.items():
            if first + len(held) <= need:
                self.samples.removeKey((first,))
        stretch: list[list[float]] = []
        for frame in sorted(k for k in new if k >= need):
            if stretch and (frame != first + len(stretch) or len(stretch) >= STRETCH):
                self.samples.updateValue((first,), (stretch,))
                stretch = []
            if not stretch:
                first = frame
            stretch.append([float(x) for x in new[frame]])
        if stretch:
            self.samples.updateValue((first,), (stretch,))
        self.held.update((seen, a, e, [list(w) for w in waiting], need))
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = {first + i: x for first, held in self._stretches().items() for i, x in enumerate(held)}
        yield self._end(key, self._state()[0], frames)

    def close(self) -> None:
        pass


def cut_stream(frames: DataFrame, limits: Limits, idle_ms: int | None = None, frame_samples: int = FRAME_SAMPLES) -> DataFrame:
    """The segments of a stream with their samples, as ``cut_samples`` gives them for a table, each once its padding has been seen.

    ``frames(source_id, frame_idx, prob, samples array<float>)``, those of a source in order. A row without ``prob`` says that its
    source is at its end; so is one without frames for ``idle_ms``, if that is given: such a stream never ends by itself, since
    timers keep it going. The session's state store must be ``STATE_STORE``."""
    kind = frames.schema["source_id"].dataType.simpleString()
    return frames.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_Cutter(limits, idle_ms, frame_samples),
        outputStructType=f"source_id {kind}, start_frame long, end_frame long, start_sample long, samples array<float>",
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
