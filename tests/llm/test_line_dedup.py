"""Line dedup: the perfect hash against dictionaries, the operator against brute force, edges."""

import collections
import random

import numpy as np
import pytest

from cuewright.llm import line_dedup as L
from cuewright.llm import perfect_hash as P

SCHEMA = "doc_id long, text string, k long, t long, high long, shard string, keys string"


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 40_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)
    high[: n // 3] = 7  # keys that share a half
    index, arrays = P.from_bytes(P.to_bytes(P.PerfectHash.of(high, low), some=np.arange(n)))
    assert sorted(index.find(high, low).tolist()) == list(range(n)) and len(arrays["some"]) == n
    assert (index.find(rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 2**64, 5000, np.uint64)) == -1).all()
    assert (index.find(high, low + np.uint64(1)) == -1).all()
    if n >= 1000:
        assert 64 * len(index.words) < 5 * n  # bits a key, beside the arrays


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        P.PerfectHash.of(np.array([3, 3], np.uint64), np.array([4, 4], np.uint64))


def brute(rows, least=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    rank = lambda i: (i is not None, i)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)], key=rank) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def got(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 1, 1, 1, "z", "z") for i, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in L.dedup(docs, **more).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def sample():
    rng = random.Random(5)
    pool = ["  Copyright Notice %d \r" % k for k in range(30)] + ["ÄÖÜ äöü %d straße" % k for k in range(10)] + ["short", "123456789", "1234567890", "ABCDEFGHIJ", "abcdefghij", "\x0babcdefghij\t", "äbcdefghiJ", "Äbcdefghij", "", " ", "é" * 9, "é" * 10]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"only of document {i} {rng.random()}" for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(i, "The Common Line of many\nown %d of it" % i) for i in range(1000, 1600)]
    rows += [(None, "abcdefghij\nwithout an id"), (None, "abcdefghij\nwithout an id"), (None, None), (-3, "abcdefghij\n1234567890"), (7, None), (8, ""), (2**62 + 1, "1234567890\nof a large id"), (2**62 + 2, "of a large id")]
    return rows + [(5000, "repeated within\nREPEATED within\nother"), (5001, "repeated within\nx\nrepeated within "), (9, rows[9][1]), (9, rows[9][1])]


def test_against_brute_force(spark):
    assert got(spark, sample()) == brute(sample())
    assert got(spark, sample()[:50], least_chars=3) == brute(sample()[:50], 3)


def test_parts_and_shards_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 5)
    monkeypatch.setattr(L, "PART_QUESTIONS", 17)
    rows = sample()
    assert got(spark, rows) == brute(rows)
    keys = L.line_keys(spark.createDataFrame(rows, "doc_id long, text string"))
    parts = [r["parts"] for r in L.shards(L.repeated_keys(keys), 9, 1).select("parts").collect()]
    assert len(parts) == 9 and max(parts) > 600 // 17  # the common line is asked for in many parts


def test_long_texts_and_no_rows(spark):
    long_ = "\n".join(f"line number {i}" for i in range(100_000))
    rows = [(1, long_), (2, long_ + "\nand one more line"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)]
    assert [r[:3] for r in got(spark, rows)] == [(1, 100_000, 0), (2, 100_001, 100_000), (3, 1, 0), (4, 1, 1)]
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 1, 0, "")]
