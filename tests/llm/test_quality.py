"""Quality rules: base counts against plain Python, distances, verdicts."""

import math
import os
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from cuewright.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, n_words int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(held), n < 20 or 100 * len(held) > 30 * n


def texts(seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "to", "é", *(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))]
    prose = lambda n: " ".join(rng.choice(vocab[:5]) if rng.random() < 0.4 else rng.choice(vocab) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    good = [prose(rng.randint(60, 400)) for _ in range(60)]
    block = prose(12)
    odd = ["", None, "few words", "x", " \x0b\n", "\x1c\x85 a b", "same line\nsame line\n\n\nsame line", f"{block} {block} {prose(10)}", "ha " * 90, "a" * 5000]
    junk = [" ".join(w + "$$$***" for w in prose(200).split()), " | ".join(f"zq{i}xj" for i in range(300)), prose(200).upper().replace(" ", "!! ")]
    return good, odd, junk


def test_base_counts():
    good, odd, junk = texts()
    for t in good + odd + junk:
        raw = (t or "").encode()
        assert Q.base_counts(raw, t or "", raw.split()) == plain(t)


def test_distance():
    assert Q.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0
    assert Q.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0.0
    assert Q.js_distance(np.zeros(2), np.zeros(2)) == 0.0 and Q.js_distance(np.zeros(2), np.ones(2)) == 1.0
    p, q = np.array([0.2, 0.8]), np.array([0.6, 0.4])
    m = (p + q) / 2
    assert abs(Q.js_distance(p, q) ** 2 - (sum(p * np.log2(p / m)) + sum(q * np.log2(q / m))) / 2) < 1e-12


def rows():
    good, odd, junk = texts()
    all_ = [(i, t, "en" if i % 5 else None) for i, t in enumerate(good + odd + junk)]
    return [(*r, 1, "k") for r in all_] + [(3, good[3], "en", 1, "k"), (None, good[0], "xx", 1, "k")], len(good), len(odd)


def test_references_count_everything(spark, monkeypatch):
    data, *_ = rows()
    df = spark.createDataFrame(data, SCHEMA)
    monkeypatch.setattr(Q, "FLUSH_WORDS", 3)
    found = Q.references(df)
    for lang in {r[2] for r in data}:
        own = [r[1] or "" for r in data if r[2] == lang]
        count = Counter(w for t in own for w in Q.plain_words(t.encode()))
        assert found[lang]["total"] == sum(count.values())
        assert found[lang]["words"] == dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:64])
        assert (found[lang]["classes"] == sum(Q.class_counts(t) for t in own)).all()


def test_verdicts(spark):
    data, n_good, n_odd = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = Q.assess(df).collect()
    assert len(got) == len(data)
    for r in got:
        text = next(x[1] for x in data if x[0] == r["doc_id"])
        assert tuple(r)[1:7] == plain(text)
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(n_good)) <= kept and not kept & set(range(n_good + n_odd, n_good + n_odd + 3))
    passed = Q.assess(df, keep_rows=True)
    assert passed.columns == df.columns and sorted((r["doc_id"] for r in passed.collect()), key=str) == sorted((r["doc_id"] for r in got if r["kept"]), key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.assess(empty).count() == 0 and Q.assess(empty, keep_rows=True).count() == 0


def test_joined_references_give_the_same(spark):
    rng = random.Random(11)
    vocabulary = {lang: [f"{lang}{rng.randrange(400)}" for _ in range(60)] for lang in ("aa", "bb", "cc", None, "dd")}
    rows = []
    for k in range(150):
        lang = rng.choice(list(vocabulary))
        other = rng.choice(list(vocabulary)) if k % 9 == 0 else lang
        rows.append((k if k % 13 else None, " ".join(rng.choice(vocabulary[other]) for _ in range(rng.choice([5, 80, 300]))), lang, "x"))
    rows += [(1000, None, "ee", "x"), (1001, "", None, "x"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, ref string")
    for keep in (False, True):
        whole = sorted(map(str, Q.assess(df, keep_rows=keep).collect()))
        assert whole and sorted(map(str, Q.assess(df, keep_rows=keep, most_langs=2).collect())) == whole


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_verdicts_by_brute_force(spark):
    """The verdict on every document of a table, from counts and distances worked out one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    limits = Q.Limits()
    plain = lambda t: "".join(" " if c in string.punctuation else c.lower() if c in string.ascii_uppercase else c for c in t)
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    words, classes = {}, {}
    for _, text, lang in rows:
        words.setdefault(lang, Counter()).update(split(plain(text)))
        classes[lang] = classes.get(lang, 0) + Q.class_counts(text)

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda x, m: x * math.log2(x / m) if x else 0.0
        return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2))

    want = {}
    for i, text, lang in rows:
        own = split(text)
        windows = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
        again = {k + j for k in range(len(own) - 7) if windows[tuple(own[k : k + 8])] > 1 for j in range(8)}
        failed = len(own) < 20 or 100 * len(again) > 30 * len(own)
        kept = not failed
        if len(text) >= limits.min_chars and len(own) >= limits.min_words:
            top = sorted(words[lang], key=lambda w: (-words[lang][w], w.encode()))[: limits.common_words]
            mine = Counter(split(plain(text)))
            hist = lambda c: [c[w] for w in top] + [sum(c.values()) - sum(c[w] for w in top)]  # noqa: E731, B023
            a, b = distance(Q.class_counts(text).tolist(), classes[lang].tolist()), distance(hist(mine), hist(words[lang]))
            kept = kept and a <= limits.class_base + limits.class_slack / len(own) ** 0.5 and b <= limits.word_base + limits.word_slack / len(own) ** 0.5
        want[i] = (len(own), len(again), failed, kept)
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in Q.assess(docs).collect()}
    assert got == want and {v[3] for v in want.values()} == {True, False}
