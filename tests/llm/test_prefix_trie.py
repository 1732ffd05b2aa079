"""The trie of conversations: against dictionaries of prefixes, for any partitioning, edges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cuewright.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, n long, first long, mark string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    convs = {c: [x for _, x in sorted(v, key=lambda t: t[0])] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
    out = []
    for k, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], sha))
    return sorted(out, key=lambda r: (r[1], r[0]))


def got(spark, rows, n=None):
    turns = spark.createDataFrame([(*r, 1, 1, "z") for r in rows], SCHEMA).repartition(3)
    out = T.nodes(T.with_shared_starts(T.sequences(turns)))
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[1], r[0]))


def sample(seed=2, convs=260, hot=150):
    rng = random.Random(seed)
    say = ["", "yes", "no", "é😀", "tell me more", None]
    rows = []
    for c in rng.sample(range(-50, 1200), convs):
        rows += [(c, t, rng.choice(["user", "bot", None]) if rng.random() < 0.3 else "user", rng.choice(say[: 2 + t % 4])) for t in range(rng.randint(1, 9))]
    for c in range(5000, 5000 + hot):  # copies: those of them that take nothing from an absent base lose their first turns only
        rows += [(c, t, "user", f"the same {t}") for t in range(7)]
    rows += [(7777, None, "user", "first"), (7777, 3, "bot", "then"), (8801, 1, "a", "short"), (None, 1, "user", "no id"), (9000, 2, None, None)]
    rng.shuffle(rows)
    return rows


def test_against_dictionaries(spark):
    assert got(spark, sample()) == brute(rebuilt(sample()))


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_borders_and_pieces_do_not_show(spark, monkeypatch, n):
    """Many partitions, groups of copies over several of them, ids in pieces of three."""
    monkeypatch.setattr(T, "PIECE_IDS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sample(seed=n, convs=90, hot=60)
        assert got(spark, rows) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_random_arrays_over_any_borders():
    """The sweep and the stitching alone, with borders at random places."""
    import pyarrow as pa

    rng = random.Random(11)
    for _ in range(300):
        convs = {c: [("u", rng.choice("abc")) for _ in range(rng.choice([0, 1, 2, 2, 3, 5]))] for c in rng.sample(range(60), rng.randint(1, 25))}
        key = lambda t: b"".join(hashlib.md5(repr(x).encode()).digest() for x in t)
        rows = sorted((key(t), c, [len(x[1]) for x in t]) for c, t in convs.items())
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 6))))
        swept = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batch = pa.RecordBatch.from_pydict({"conv_id": [r[1] for r in rows[a:b]], "key": [r[0] for r in rows[a:b]], "chars": [r[2] for r in rows[a:b]]})
            swept += [x for out in T._sweep(iter([batch])) for x in out.to_pylist()]
        parts = [x for x in swept if x["kind"] == "part"]
        joints = [x for out in T._stitch(iter([pa.RecordBatch.from_pylist(parts, schema=T._ARROW)])) for x in out.to_pylist()]
        nodes = [x for x in swept + joints if x["kind"] == "node"]
        called = {(x["first"], x["depth"]): x["least"] for x in nodes + joints}
        ids = {}
        for x in swept:
            if x["kind"] == "ends":
                ids.setdefault(x["mark"], []).append((x["first"], x["ids"]))
        sha = lambda x: x["ends"] or hashlib.sha256(",".join(s for _, s in sorted(ids[x["mark"]])).encode()).hexdigest()
        made = [(x["least"], x["depth"], called.get((x["parent"], x["depth"] - 1)), x["n"], x["children"], x["leaves"], x["saved"], sha(x)) for x in nodes]
        assert sorted(made, key=lambda r: (r[1], r[0])) == brute(convs)


def test_one_long_conversation_ties_and_no_rows(spark):
    long_ = [(200, t, "user", "x" * (t % 3)) for t in range(3000)] + [(300, 0, "u", "y" * 300_000)]
    assert got(spark, long_) == brute(rebuilt(long_))
    tied = [(100, 1, "u", "b"), (100, 1, "u", "a"), (100, 1, "u", "a"), (101, 1, "u", "a")]
    one, other = (sorted(map(str, got(spark, r))) for r in (tied, tied[::-1]))
    assert one == other
    assert got(spark, []) == [] and got(spark, [(None, 1, "u", "x")]) == []


def test_common_turns():
    a = bytes(range(16)) + b"x" * 16
    assert T.common(a, a) == 2 and T.common(a, a[:16]) == 1 and T.common(a, b"") == 0 and T.common(a, b"y" + a[1:]) == 0 and T.common(a + b"a" * 16, a + b"b" * 16) == 2


def test_texts_are_read_whole(spark):
    turns = spark.createDataFrame([(1, 0, "u", "x" * 100_000 + "a"), (2, 0, "u", "x" * 100_000 + "b")], "conv_id long, turn long, role string, text string")
    a, b = (r["turns"][0] for r in T.sequences(turns).orderBy(F.col("conv_id")).collect())
    assert a["digest"] != b["digest"] and a["chars"] == b["chars"] == 100_001
