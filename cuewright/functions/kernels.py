"""Array kernels over numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; nulls in either array make it null, the shorter length pads with null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pointwise(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A 1x1 convolution at one place: for each output channel the dot product with its weights, plus bias."""
    rows = [dot(x, F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, bias, strict=True)]
    return F.array(*rows)


def real_time_factor(secs: Column, audio_secs: Column) -> Column:
    """Processing time over audio time, three decimals; null for no audio."""
    return F.when(audio_secs > 0, F.round(secs / audio_secs, 3))
