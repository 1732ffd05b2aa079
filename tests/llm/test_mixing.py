"""Mixing: targets against a plain loop, exact takes, disjoint pieces, shards."""

import random

import numpy as np

from cuewright.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, n_chars long, size int"


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 1, 5, 60, 900]))), rng.choice(["a", "a", "a", "b", "ç", None]), 0, 7) for i in range(150)]
    rows += [(None, None, "b", None, 7), (5, "w5 twice", "a", 0, 7), (5, "w5 twice", "a", 0, 7), (900, "tiny", "z", 0, 7), (901, "\t\x0b", "empty", 0, 7)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_by_a_plain_loop():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, rng.randint(0, 10**6)]) for _ in range(rng.randint(1, 9))]
        weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
        got = M.targets(sizes, weights)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
        assert all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes, strict=True))
        free = [(t / w) for t, n, w in zip(got, sizes, weights, strict=True) if t < 2 * n - 1e-6]
        assert not free or max(free) - min(free) < 1e-6 * max(free)
        assert all(t / w <= min(free) * (1 + 1e-9) for t, w in zip(got, weights, strict=True)) if free else True


def test_quotas_sum_and_are_even():
    draws = np.array([1000, 10, 0, 333])
    out = M.split_quotas(draws, 7, np.random.default_rng(1))
    assert (out.sum(axis=0) == draws).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 3


def test_the_tree_has_no_bound_on_shards():
    """20,000 shards of 5,000 sources: every shard has as many draws, of any source what all shards together leave."""
    rng = random.Random(6)
    sizes = [(f"s{i:04d}", rng.randint(8_000, 24_000)) for i in range(5000)]
    made = M.plan(sizes, shard_words=6000)
    tree = made["s0000"].tree
    assert tree.shards > 19_000 and tree.shards == -(-round(sum(s.target for s in made.values())) // 6000)
    words = []
    for first in (0, 7_777, tree.shards - 3):
        for quota in tree.quotas(first, first + 3):
            words.append(sum(q * s.block for q, s in zip(quota.tolist(), made.values(), strict=True)))
    assert max(words) < 1.3 * 6000 and min(words) > 0.7 * 6000
    small = M.Tree(np.array([5000, 40, 0, 777]), 301, 9)
    ends = np.cumsum(np.array(list(small.quotas())), axis=0)
    for i in range(4):
        draws = np.arange(ends[-1, i])
        assert (small.shards_of(i, draws[::-1])[::-1] == np.searchsorted(ends[:, i], draws, side="right")).all()


def test_targets_of_very_many_sources():
    import time

    began = time.perf_counter()
    got = M.targets([1 + i % 1000 for i in range(200_000)], [M.WEIGHTS[i % 3] for i in range(200_000)])
    assert abs(sum(got) - 1.5 * sum(1 + i % 1000 for i in range(200_000))) < 1 and time.perf_counter() - began < 5


def test_rows_of_one_id_and_size(spark):
    """Different texts of one id and size have places of their own, the same in any order of the rows."""
    rows = [(1, f"{'abcdefgh'[i % 8]} x{i} y", "a") for i in range(60)] + [(2, "z " * 500, "b")]
    takes = lambda df: sorted((r["text"], r["mix_shard"]) for r in M.mix(df, shard_words=20).collect())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert takes(df) == takes(spark.createDataFrame(rows[::-1], df.schema).repartition(5))


def test_hypergeometric_beyond_the_library():
    rng = np.random.default_rng(5)
    good, bad, size = 700_000_000, 900_000_000, 400_000_000
    got = np.array([M.hypergeometric(good, bad, size, rng) for _ in range(400)], dtype=float)
    mean, total = size * good / (good + bad), good + bad
    spread = (mean * bad / total * (total - size) / (total - 1)) ** 0.5
    assert abs(got.mean() - mean) < 5 * spread / 20 and 0.8 < got.std() / spread < 1.2
    held = np.array([3_000_000_000, 5_000_000_000, 0, 7])
    out = M.split_quotas(held, 6, rng)
    assert (out.sum(axis=0) == held).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 3 and len(set(out[:, 0])) > 1
    assert M.hypergeometric(0, 5_000_000_000, 10, rng) == 0 and M.hypergeometric(5_000_000_000, 3, 5_000_000_003, rng) == 5_000_000_000


def test_takes_are_exact_and_disjoint():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [(f"s{i}", rng.choice([0, 1, 63, 65, 1000, rng.randint(1, 300_000)])) for i in range(4)]
        for source in M.plan(sizes, shard_words=20_000).values():
            cuts = sorted({0, source.size, *(rng.randint(0, source.size) for _ in range(15))})
            taken = {}
            for a, b in zip(cuts, cuts[1:], strict=False):
                for turn, _, x, y in source.pieces(a, b):
                    assert a <= x < y <= b
                    taken.setdefault(turn, []).append((x, y))
            assert sum(y - x for own in taken.values() for x, y in own) == round(source.target)
            for own in taken.values():
                own.sort()
                assert all(p[1] <= q[0] for p, q in zip(own, own[1:], strict=False))


def test_mix_sizes(spark):
    rows, df = table(spark)
    got = M.mix_sizes(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix_sizes(df.repartition(7)).collect()), key=str)
    words = lambda t: len((t or "").encode().split())
    assert sorted(r["size"] for r in got) == sorted(words(r[1]) for r in rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), 0)
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(n == round(t) for (_, t), n in by.items())
    for r in M.mix_sizes(df, shard_words=2000).collect():
        assert sum(int(x.split(":")[1]) for x in r["shards"].split(",") if x) == r["taken"]
    # Shards hold equal numbers of block draws, so about equal numbers of words.
    words: dict = {}
    for r in M.mix_sizes(df, shard_words=2000).collect():
        for x in filter(None, r["shards"].split(",")):
            words[x.split(":")[0]] = words.get(x.split(":")[0], 0) + int(x.split(":")[1])
    assert len(words) > 5 and sorted(map(int, words)) == list(range(len(words)))


def test_taken_against_a_plain_loop(spark):
    """Every row's share, from its place on the line and the block draws laid out one by one."""
    rows, df = table(spark, 4)
    got = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in M.mix_sizes(df, shard_words=2000).collect())
    sized = M.written(M._sized(df, "doc_id", "text", "source"), "sizes")
    placed, sizes = M._placed(sized, {k: k for k in ("id", "source", "size", "mark")}, 150)
    made = M.plan(sizes, shard_words=2000)
    taken = {}
    for name, s in made.items():
        line = np.zeros(s.size, dtype=int)
        for turn in range(s.passes + 1):
            order = np.argsort(M._scramble(s.blocks, s.key + turn)(np.arange(s.blocks))) if s.blocks else []
            left = s.size if turn < s.passes else round(s.target) - s.passes * s.size
            for block in order:
                n = min(left, s.block, s.size - block * s.block)
                line[block * s.block : block * s.block + n] += 1
                left -= n
        taken[name] = line
    want = sorted((str(r["id"]), r["size"], int(taken[r["source"]][r["__cw_start"] : r["__cw_start"] + r["size"]].sum())) for r in placed.collect())
    assert got == want


def test_sources_that_are_not_strings(spark):
    df = spark.createDataFrame([(i, "a b c " * i, i % 3 if i % 5 else None) for i in range(40)], "doc_id long, text string, source int")
    assert sum(len(r["text"].split()) for r in M.mix(df).collect()) == sum(r["taken"] for r in M.mix_sizes(df).collect()) > 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "x", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in M.mix_sizes(df, shard_words=50_000).collect()}
    assert got[1]["size"] == 400_000 and got[1]["taken"] == round(got[1]["target"]) and got[1]["shards"].count(":") > 5


def test_mix_rows(spark, tmp_path):
    rows, df = table(spark)
    mixed = M.mix(df, shard_words=2000)
    assert mixed.columns == [*df.columns, "mix_shard", "mix_order"]
    got = mixed.collect()
    texts = {}
    for i, t, s, *_ in rows:
        texts.setdefault((i, s), []).append(t or "")
    assert all(any(r["text"] in t for t in texts[r["doc_id"], r["source"]]) and r["n_chars"] == len(r["text"]) for r in got)
    taken = sum(r["taken"] for r in M.mix_sizes(df, shard_words=2000).collect())
    assert sum(len(r["text"].split()) for r in got) == taken
    M.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(got) and {r[0] for r in back.select("mix_shard").distinct().collect()} == {r["mix_shard"] for r in got}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix_sizes(empty).count() == 0 and M.mix(empty).count() == 0
