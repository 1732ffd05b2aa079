"""Suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cuewright.llm import suffixes as S

SCHEMA = "doc_id long, text string, spans string, id string, rid long"  # with names that the operator uses itself


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(300)) for _ in range(6)]
    texts = [None, "", "a" * 90, "short", "ab" * 60]
    while len(texts) < n:
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 80)))
        for _ in range(rng.randint(0, 2)):
            b = rng.choice(base)
            at = rng.randint(0, 200)
            t += b[at : at + rng.randint(10, 100)] + rng.choice("xyz")
        texts.append(t)
    return texts + texts[5:15]


@pytest.mark.parametrize(("length", "gram", "crowd"), [(20, 8, 64), (20, 8, 2), (24, 24, 3)])
def test_against_brute_force(spark, length, gram, crowd):
    texts = corpus(length + crowd)
    rows = [(i if i % 11 else None, t, "x", "y", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", "y", 1)] * 2
    got = S.dedup(spark.createDataFrame(rows, SCHEMA), length=length, gram=gram, crowd=crowd).collect()
    want = brute([(r[1] or "").encode() for r in rows], length)
    key = lambda i, x: (str(i), *x)
    assert sorted(key(r["doc_id"], r[1:5]) for r in got) == sorted(key(r[0], w) for r, w in zip(rows, want, strict=True))


def test_copies_are_found_by_the_order():
    """A segment repeats because the order puts its two copies beside one another; alone it does not."""
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b"abcd") for _ in range(60)) for _ in range(5)]
    runs = [41] * 5
    assert S.repeated_windows(pieces, runs, 20) == [[]] * 5
    assert S.repeated_windows(pieces + pieces[1:3], runs + [41, 41], 20) == [[], [(0, 41)], [(0, 41)], [], [], [(0, 41)], [(0, 41)]]


def test_many_copies_of_one_text(spark):
    """A third of all rows are one text; a row of its own id holds the same; copies may be rows repeated."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(40)]
    rows = [(i, words[0]) for i in range(40)] + [(100 + i, w) for i, w in enumerate(words)] + [(7, words[0])] * 2 + [(500, words[3]), (500, words[3]), (None, words[5])]
    for crowd in (64, 1):
        got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=8, crowd=crowd).collect()
        want = brute([t.encode() for _, t in rows], 20)
        assert sorted((str(r["doc_id"]), *r[1:5]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 150)
        raw = bytes(rng.choice(rng.choice([b"ab", b"a", bytes(range(256))])) for _ in range(n))
        data = np.frombuffer(raw + bytes(40), dtype=np.uint8)
        wanted = np.zeros(len(data), dtype=bool)
        wanted[:n] = [rng.random() < 0.6 for _ in range(n)]
        order = S.two_stage_order(data, wanted, 24)
        keys = [data.tobytes()[i : i + 24] for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        for a, b, n_same in zip(keys, keys[1:], S.common_prefixes(data, order, 24).tolist(), strict=False):
            assert n_same == next((i for i in range(24) if a[i] != b[i]), 24)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    text = bytes(random.Random(4).choice(b"abcd") for _ in range(500))
    _, start, run, *_ = S.segments([text], 20, 8)
    covered = sorted(w for a, r in zip(start.tolist(), run.tolist(), strict=True) for w in range(a, a + r))
    assert covered == list(range(481))
