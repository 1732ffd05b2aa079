"""Kernels over ordered frames: a depthwise convolution in time, and a long short-term memory carried from frame to frame.

Frames are ``(source_id, frame, x array<double>)``. Weights come as tables of a model's size: ``matrix`` reads them to the driver, which
sends them to the tasks; it refuses tables beyond ``MOST_WEIGHTS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
MOST_WEIGHTS = 4_000_000
TAPS = 5


def matrix(weights: DataFrame, row: str, values: str) -> np.ndarray:
    """The rows of ``weights`` by ``row``, each an array of equal length in ``values``."""
    size = weights.agg(F.sum(F.size(values))).first()[0] or 0
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} numbers are no model's weights")
    return np.array([list(r[0]) for r in weights.orderBy(row).select(values).collect()], float)


def depthwise(frames: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """``frames`` with ``y``: each channel's sum over five frames, two on either side, with its own row of ``weights``, and its ``bias``.
    Frames that are not there count as zero.

    A source is worked on in chunks of frames; the two frames at either end of a chunk stand in both."""
    reach = TAPS // 2
    own = F.floor(F.col("frame") / CHUNK)
    near = F.sequence(F.floor((F.col("frame") - reach) / CHUNK), F.floor((F.col("frame") + reach) / CHUNK))
    dealt = frames.withColumn("__own", own).withColumn("__chunk", F.explode(near))
    around = Window.partitionBy("source_id", "__chunk").orderBy("frame").rangeBetween(-reach, reach)
    met = dealt.withColumn("__near", F.collect_list(F.struct("frame", "x")).over(around)).where("__own = __chunk")
    w = F.array(*(F.array(*map(F.lit, map(float, row))) for row in weights))
    b = F.array(*map(F.lit, map(float, bias)))

    def channel(c):
        tap = lambda s, n: s + F.get(n["x"], c) * F.get(F.get(w, c), (n["frame"] - F.col("frame") + reach).cast("int"))
        return F.aggregate(F.array_sort("__near"), F.get(b, c), tap)

    y = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), channel)
    return met.withColumn("y", y).drop("__own", "__chunk", "__near")


def lstm(frames: DataFrame, w: np.ndarray, r: np.ndarray, bias: np.ndarray) -> DataFrame:
    """``source_id, frame, h``: the hidden vector behind each frame, from zero in each source.

    ``w`` has the rows of the input, output, forget and cell gates for ``x``, ``r`` those for the hidden vector; ``bias`` both their
    biases, one behind the other. Frames of a source follow one another in one task, which holds two vectors: each step needs the one
    before it."""
    kind = frames.schema["source_id"].dataType.simpleString()
    size = r.shape[1]
    both = bias[: 4 * size] + bias[4 * size :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigmoid = lambda v: 1.0 / (1.0 + np.exp(-v))
        at, h, c = None, np.zeros(size), np.zeros(size)
        for batch in batches:
            inputs = np.array(batch.column("x").to_pylist(), float)
            through = inputs @ w.T + both
            out = []
            for k, source in enumerate(batch.column("source_id").to_pylist()):
                if k == 0 and at is None or source != at:
                    at, h, c = source, np.zeros(size), np.zeros(size)
                i, o, f, g = np.split(through[k] + r @ h, 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                out.append(h)
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("frame"), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["source_id", "frame", "h"])

    ordered = frames.select("source_id", F.col("frame").cast("long").alias("frame"), F.col("x").cast("array<double>").alias("x"))
    return ordered.repartition("source_id").sortWithinPartitions("source_id", "frame").mapInArrow(run, f"source_id {kind}, frame long, h array<double>")
