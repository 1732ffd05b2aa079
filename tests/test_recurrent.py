"""Kernels over frames against plain loops; two tracks beside one another against all pairs."""

import math
import random

import numpy as np
import pytest

from cuewright.operators import quality, recurrent


def framed(spark, seed=1):
    rng = random.Random(seed)
    rows = [(s, i, [rng.uniform(-1, 1) for _ in range(3)]) for s, n in (("a", 40), ("b", 1), ("c", 7)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "source_id string, frame long, x array<double>").repartition(3)


@pytest.mark.parametrize("chunk", [1, 2, 5, 65_536])
def test_depthwise(spark, monkeypatch, chunk):
    monkeypatch.setattr(recurrent, "CHUNK", chunk)
    rows, df = framed(spark)
    rng = np.random.default_rng(2)
    w, b = rng.normal(size=(3, 5)), rng.normal(size=3)
    x = {(s, i): v for s, i, v in rows}
    got = {(r["source_id"], r["frame"]): r["y"] for r in recurrent.depthwise(df, w, b).collect()}
    assert got.keys() == x.keys()
    for (s, i), y in got.items():
        want = [b[c] + sum(x[s, i + k - 2][c] * w[c, k] for k in range(5) if (s, i + k - 2) in x) for c in range(3)]
        assert np.allclose(y, want, rtol=0, atol=1e-12)


def test_lstm(spark):
    rows, df = framed(spark, 3)
    rng = np.random.default_rng(4)
    w, r, bias = rng.normal(size=(8, 3)), rng.normal(size=(8, 2)), rng.normal(size=16)
    got = {(x["source_id"], x["frame"]): x["h"] for x in recurrent.lstm(df, w, r, bias).collect()}
    for s in ("a", "b", "c"):
        h, c = [0.0, 0.0], [0.0, 0.0]
        for _, i, x in sorted(q for q in rows if q[0] == s):
            gate = lambda row: bias[row] + bias[8 + row] + sum(w[row, k] * x[k] for k in range(3)) + sum(r[row, k] * h[k] for k in range(2))  # noqa: B023, E731
            sigmoid = lambda v: 1 / (1 + math.exp(-v))
            z = [gate(row) for row in range(8)]
            c = [sigmoid(z[4 + n]) * c[n] + sigmoid(z[n]) * math.tanh(z[6 + n]) for n in range(2)]
            h = [sigmoid(z[2 + n]) * math.tanh(c[n]) for n in range(2)]
            assert np.allclose(got[s, i], h, rtol=0, atol=1e-12)
    assert recurrent.lstm(df.limit(0), w, r, bias).count() == 0
    table = spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0])], "row int, v array<double>")
    assert recurrent.matrix(table, "row", "v").tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_refuses_what_is_no_model(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "MOST_WEIGHTS", 3)
    with pytest.raises(ValueError, match="4 numbers"):
        recurrent.matrix(spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0])], "row int, v array<double>"), "row", "v")


def test_tracks(spark):
    rng = random.Random(8)

    def track():
        out = []
        for s in "xyz":
            for k in range(40):
                a = rng.choice([0, 19_999, 20_000, rng.randint(0, 200_000)])
                out.append((s, a, a + rng.choice([0, 1, 20_000, rng.randint(1, 70_000)]), f"{s}{k}"))
        return out

    left, right = track(), [*track(), ("w", 5, 9, "alone")]
    schema = "source_id string, start_ms long, end_ms long, text string"
    dfs = [spark.createDataFrame(t, schema) for t in (left, right)]
    pairs = sorted((r["left_text"], r["right_text"], r["overlap_ms"]) for r in quality.overlaps(*dfs).collect())
    want = sorted((p[3], q[3], min(p[2], q[2]) - max(p[1], q[1])) for p in left for q in right if p[0] == q[0] and min(p[2], q[2]) > max(p[1], q[1]))
    assert pairs == want and len(want) > 100
    rows = {(r["source_id"], r["bucket"]): r for r in quality.side_by_side(*dfs).collect()}
    assert rows["w", 0]["right"] == "alone" and rows["w", 0]["n_left"] == 0 and rows["w", 0]["left"] == ""
    assert sum(r["n_left"] for r in rows.values()) == len(left) and sum(r["n_right"] for r in rows.values()) == len(right)
    assert sum(r["overlap_ms"] for r in rows.values()) == sum(w[2] for w in want)
