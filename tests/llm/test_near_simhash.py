"""Near copies are found by SimHash: fingerprints, their variants, and dense groups."""

import random

import numpy as np

from cuewright.llm import near_copies as N
from cuewright.llm import simhash as S


def plain_fingerprint(found):
    words = []
    for t, p in zip(N._TIMES.tolist(), N._PLUS.tolist(), strict=True):
        ones = [0] * 64
        for h in found.tolist():
            x = (h * t + p) % 2**64
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 % 2**64
            x ^= x >> 29
            for b in range(64):
                ones[b] += x >> b & 1
        words.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(found)))
    return words


def test_fingerprint_is_the_majority_of_each_bit():
    for n in (1, 2, 255, 256, 300):
        found = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
        assert [x % 2**64 for x in N.fingerprint(found)] == plain_fingerprint(found)


def test_variants_find_what_shares_three_bytes_of_a_segment(spark):
    zero = [0] * N.WORDS
    everywhere = lambda x: [x - 2**64 if x >= 2**63 else x] * N.WORDS
    rows = [(1, zero), (2, everywhere(0xFF_0000_0101_01FF)), (3, everywhere(0x0101_0101_0101_0101))]
    ks = {}
    for r in N._variants(spark.createDataFrame(rows, "node long, fp array<long>")).collect():
        ks.setdefault(r["node"], set()).add(r["k"])
    assert all(len(k) == 8 * N.WORDS for k in ks.values())
    # 1 and 2 differ in one byte of the upper half, 2 and 3 in one of the lower, 1 and 3 in all.
    assert len(ks[1] & ks[2]) == len(ks[2] & ks[3]) == N.WORDS and not ks[1] & ks[3]


def test_recall_at_the_least_similarity():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(200):
        both = rng.integers(0, 1 << 64, 160, dtype=np.uint64)
        a, b = (np.array(N.fingerprint(np.concatenate([both, rng.integers(0, 1 << 64, 20, dtype=np.uint64)]))).view("<u1").reshape(-1, 4) for _ in "ab")
        bits = np.unpackbits((a ^ b).ravel()).sum()
        assert bits <= N.MOST_BITS
        met += bool(((a == b).sum(axis=1) >= 3).any())
    assert met >= 194


def test_dense_groups_in_rounds(spark, monkeypatch):
    """Groups larger than what is compared in pairs, whose members are not all near their hub."""
    monkeypatch.setattr(N, "DENSE", 3)
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own))
    sets = [N.shingles(t.encode()) for t in texts]
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if low[i] != low[j] and N.similar(sets[i], sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (1, 3):
        monkeypatch.setattr(N, "ROUNDS", rounds)
        assert {r["doc_id"] for r in S.keep_one(df).collect()} == set(low)


def edited(rng, base, most):
    own = list(base)
    for at in rng.sample(range(len(own)), rng.randint(0, most)):
        own[at] = f"x{rng.randrange(10**9)}"
    return " ".join(own)


def brute_links(texts):
    sets = [N.shingles(t.encode()) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if N.similar(sets[i], sets[j])}


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Copies with many edits, most of them not near copies of one another: what is verified stays in proportion."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(rng, base, 8) for _ in range(300)]
    seen = []
    plain = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = list(range(len(texts)))
    links, changed = brute_links(texts), True
    while changed:
        changed = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    assert {r["doc_id"] for r in S.keep_one(df).collect()} == set(low)
    assert len(links) > 5000 and sum(seen) < 10 * len(texts)


def test_first_common_rare_shingles_meet(spark):
    """Every similar pair shares a rare shingle at places that leave enough, whatever the sizes."""
    rng = random.Random(7)
    texts = []
    for n in (9, 10, 30, 100):
        base = [f"v{i}" for i in range(n)]
        texts += [edited(rng, base[: rng.randint(n * 8 // 10, n)], max(1, n // 50)) for _ in range(50)]
    texts = sorted({*texts, "v0 v1 v2 v3 v4"})
    rows = [(i, len(s := N.shingles(t.encode())), s.view(np.int64).tolist()) for i, t in enumerate(texts)]
    rare = N._rare(spark.createDataFrame(rows, "node long, n int, found array<long>")).collect()
    under = {}
    for r in rare:
        under.setdefault(r["t"], []).append(r)
    met = {(max(a["node"], b["node"]), min(a["node"], b["node"])) for own in under.values() for a in own for b in own if a["node"] != b["node"] and 9 * min(a["n"] - a["i"], b["n"] - b["i"]) >= 4 * (a["n"] + b["n"])}
    want = brute_links(texts)
    assert len(want) > 200 and want <= met
