"""SimHash near-dedup against all pairs."""

import random

import pytest
import xxhash

from cuewright.llm import simhash as S
from cuewright.llm.components import components

SCHEMA = "doc_id long, text string, fingerprint string, fp int, root string"


def plain(text):
    words = (text or "").encode().translate(S._LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    low = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return low


def test_fingerprint():
    for t in [None, "", " \n", "One", "a b", "A b C", "the cat sat on the mat the cat sat", "é\x0bx y z", "w " * 500]:
        assert S.simhash((t or "").encode()) & (2**64 - 1) == plain(t)


@pytest.mark.parametrize("dense", [48, 2])
def test_links_keep_all_components(spark, dense):
    rng = random.Random(dense)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:  # chains and dense balls
        for _ in range(12):
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = S.links(df, dense).collect()
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 2 for r in edges)
    roots = {r["node"]: r["root"] for r in components(S.links(df, dense)).collect()}
    low = groups([f & (2**64 - 1) for f in fps])
    assert [roots.get(f, f) for f in fps] == [fps[k] for k in low]


def docs(spark):
    long_ = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long_), (2, long_), (9, long_ + " tail"), (7, None), (None, ""), (3, "  "), (8, "other words here"), (8, "other words here"), (None, long_), (1, "x" * 10_000)]
    return spark.createDataFrame([(i, t, "f", 1, "r") for i, t in rows], SCHEMA)


def test_near_duplicates(spark):
    got = S.near_duplicates(docs(spark)).collect()
    assert len(got) == 10
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert {c for _, c in of[5] | of[2]} == {2} and of[7] == of[3] == {("0" * 16, 3)} and len(of[8]) == 1
    assert {c for _, c in of[None]} == {2, 3}


def test_keep_one(spark):
    df = docs(spark)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    components_ = {r["component_id"] for r in S.near_duplicates(df).collect()}
    assert ids == sorted(components_, key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
