"""Marks are ranges, not windows, and copies are settled whole."""

import random

import numpy as np
import pytest

from cuewright.llm import suffixes as S
from test_suffixes import brute


def near_copies(seed, n):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh é") for _ in range(600))
    out = []
    for i in range(n):
        at = rng.randrange(500)
        out.append(f"{i} {base[:at]}#{i}#{base[at:]}")
    return out


@pytest.mark.parametrize("crowd", [2, 512])
def test_marks_are_ranges(spark, monkeypatch, crowd):
    tables = {}
    real = S.written
    monkeypatch.setattr(S, "written", lambda df, label: tables.setdefault(label, real(df, label)))
    texts = near_copies(3, 40) + near_copies(3, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = S.dedup(df, length=40, gram=16, crowd=crowd)
    got = sorted((r["doc_id"], *r[1:5]) for r in out.collect())
    assert got == [(i, *w) for i, w in enumerate(brute([t.encode() for t in texts], 40))]
    marks = tables["marks"].collect()
    assert sum(len(r["marks"]) for r in marks) <= 2 * len(marks)  # a changed place tears a segment at most once
    assert "explode(marks" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ties_longer_than_a_chance():
    rng = random.Random(2)
    for _ in range(60):
        some = bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 120)))
        raw = b"".join(some[rng.randrange(20) :] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(4)) + b"a" * rng.randint(0, 90)
        data = np.frombuffer(raw + bytes(80), dtype=np.uint8)
        wanted = np.zeros(len(data), dtype=bool)
        wanted[: len(raw)] = [rng.random() < 0.8 for _ in raw]
        order = S.two_stage_order(data, wanted, 60)
        keys = [data.tobytes()[i : i + 60] for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        for a, b, n_same in zip(keys, keys[1:], S.common_prefixes(data, order, 60).tolist(), strict=False):
            assert n_same == next((i for i in range(60) if a[i] != b[i]), 60)
