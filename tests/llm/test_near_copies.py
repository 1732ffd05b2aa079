"""Near copies against all pairs."""

import random

from cuewright.llm import near_copies as N
from cuewright.llm import simhash as S


def plain(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(texts):
    low, sets = list(range(len(texts))), [plain(t) for t in texts]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if low[i] != low[j] and 5 * len(a & b) >= 4 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return set(low)


def test_keep_one_at_the_jobs_similarity(spark):
    rng = random.Random(3)
    texts = []
    for g in range(30):  # copies with a few words changed, so that pairs lie on both sides of 0.8; some chains
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        for k in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own))
            base = own if g % 3 == 0 else base
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept(texts)
    assert 40 < len(want) < 160
    assert {r["doc_id"] for r in S.keep_one(df).collect()} == want


def test_one_changed_word_is_a_near_copy(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:40], "new", *words[41:]]), "a b c", "A  b c", "a b d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in S.keep_one(df).collect()} == {0, 2, 4}


def test_limit_is_met_exactly():
    import numpy as np

    a = np.arange(9, dtype=np.uint64)
    assert N.similar(a, np.arange(1, 10, dtype=np.uint64)) and not N.similar(a, np.arange(2, 11, dtype=np.uint64))
