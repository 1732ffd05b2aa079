"""Fingerprints against plain Python; closed syncmers are context-free."""

import bisect
import hashlib
import random

from pyspark.sql import functions as F

from cuewright.llm import syncmers as S

SCHEMA = "doc_id long, text string, sketch string, n_chars int"
LONG = " ".join(f"word{i * 7 % 101}x{i % 13}" for i in range(700))


def rows():
    texts = ["", None, "a", "one two three", "日本語" * 40, LONG, LONG, "x" * 3000, "tab\tand\nline", LONG[:900] + " other " + LONG[900:1500], "😀 é " * 9]
    return [(i * 3, t, "s", 1) for i, t in enumerate(texts)] + [(None, "no id", "s", 1), (6, "same id", "s", 1)]


def check(spark, got):
    own = [(r[0], r[1] or "") for r in rows()]
    tie = {t: h for t, h in spark.createDataFrame([(t,) for _, t in own], "t string").select("t", F.xxhash64("t")).collect()}
    own.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for k, (i, t) in enumerate(own):
        after = own[(k + 1) % len(own)][1]
        n = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)


def test_edited(spark):
    got = S.edited_fingerprints(spark.createDataFrame(rows(), SCHEMA)).collect()
    check(spark, got)
    by = {r["doc_id"]: r for r in got}
    assert by[15]["fingerprint"] == by[18]["fingerprint"] != by[27]["fingerprint"]
    assert by[0]["fingerprint"] == by[3]["fingerprint"] == "" and by[3]["near_next"] == 1.0
    assert by[18]["near_next"] == 1.0 and 0.3 < by[15]["near_edited"] < 0.8
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_ranges_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(S.with_next, "__defaults__", (2,))
    check(spark, S.edited_fingerprints(spark.createDataFrame(rows(), SCHEMA)).collect())


def test_anchors_are_closed_and_context_free(spark):
    df = spark.createDataFrame([(1, LONG), (2, "before this " + LONG + " after that"), (3, "too short"), (4, None)], "i int, text string")
    got = {r["i"]: [(a["place"], a["hash"]) for a in r["a"]] for r in S.with_anchors(df, "text", "a").collect()}
    tokens = LONG.split()
    pairs = spark.createDataFrame([(k, *tokens[k : k + 2]) for k in range(len(tokens) - 1)], "k int, a string, b string")
    h = [r[1] for r in pairs.select("k", F.xxhash64("a", "b")).orderBy("k").collect()]
    want = [k for k in range(len(h) - 3) if min(h[k], h[k + 3]) <= min(h[k + 1], h[k + 2])]
    assert [p for p, _ in got[1]] == want
    assert {(p + 2, x) for p, x in got[1]} <= set(got[2])
    assert len(got[3]) == 1 and got[4] == []


def test_scripts_without_spaces(spark):
    """One character in front shifts the anchors' places, not the anchors; other scripts keep their tokens."""
    rng = random.Random(2)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2000))
    mixed = "abc" + text[:3] + "de-f " + "x" * 15 + "ไทย"
    df = spark.createDataFrame([(1, text), (2, "文" + text), (3, mixed)], "i int, text string")
    got = {r["i"]: {(a["place"], a["hash"]) for a in r["a"]} for r in S.with_anchors(df, "text", "a").collect()}
    moved = {(p + 1, x) for p, x in got[1]}
    assert len(got[1]) > 500 and len(moved & got[2]) > 0.99 * len(moved)
    tokens = df.where("i = 3").select(S._tokens(F.col("text"))).first()[0]
    assert tokens == ["abc", *text[:3], "de-f", "x" * 12, "x" * 3, *"ไทย"]


def test_bounds(spark):
    """As many bounds as there may be, found in two steps, by expressions of a few nodes."""
    rng = random.Random(3)
    for n in (0, 1, 2, 255, 256, 257, 5000, 65_535):
        bounds = sorted(rng.sample(range(-(10**12), 10**12), n))
        keys = [rng.choice(bounds) + rng.randint(-1, 1) if bounds else 5 for _ in range(30)] + [-(1 << 63), (1 << 63) - 1]
        df = S._bucketed(spark.createDataFrame([(k,) for k in keys], "__cw_key long"), bounds)
        assert all(r["__cw_b"] == bisect.bisect_right(bounds, r["__cw_key"]) for r in df.collect())


def test_plan_has_no_python(spark):
    plan = S.edited_fingerprints(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_and_single(spark):
    assert S.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = S.edited_fingerprints(spark.createDataFrame([(1, LONG, "s", 1)], SCHEMA)).collect()
    assert one[0]["near_next"] == 1.0
