"""Sharding: nothing lost, tiers, versions, a lost race."""

import uuid

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from cuewright.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, tier string"


def table(spark, a, b):
    return spark.createDataFrame([(i if i % 9 else None, None if i % 7 == 0 else f"text {i} {uuid.uuid4()}", "s", "t") for i in range(a, b)], SCHEMA)


def test_plan_merges():
    shard = lambda k, n: S.Shard(f"p{k}", n, 1, S.tier_of(n))
    small = [shard(k, 100_000) for k in range(10)]
    groups = S.plan_merges([*small, shard(99, 50 << 20)], target=450_000, fan=4)
    assert [len(g) for g in groups] == [4, 4, 2] and not S.plan_merges(small[:3], 450_000)
    assert S.tier_of(1) == 0 and S.tier_of(S.FLOOR * 4) == 1 and S.tier_of(S.FLOOR * 4 + 1) == 2


def test_store(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/store")
    assert store.manifest()["version"] == 0
    for k in range(6):
        store.append(table(spark, 20 * k, 20 * k + 20).coalesce(1), rows=5)
    before = sorted(map(str, store.read().collect()))
    n = len(store.manifest()["shards"])
    version = store.compact(target=1 << 20)
    assert version == 7 and len(store.manifest()["shards"]) < n == 24
    assert sorted(map(str, store.read().collect())) == before and sorted(map(str, store.read(6).collect())) == before
    store.expire()
    assert store.versions() == [7] and sorted(map(str, store.read().collect())) == before
    assert len(list((tmp_path / "store").glob("arrivals-*/part-*"))) == 0


def test_one_file_for_each_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MERGES_PER_JOB", 8)  # several jobs a round
    monkeypatch.setattr(S, "PART_SHARDS", 10)
    store = S.Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(4800).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store.append(rows.repartition(4), rows=25)
    first = store.manifest()
    before = sorted(map(tuple, store.read().collect()))
    size = max(s.bytes for s in first["shards"])
    target = 10 * size
    groups = S.plan_merges(first["shards"], target)
    assert len(groups) >= 19 and len(first["parts"]) == -(-len(first["shards"]) // 10)
    made = store._merged(groups, rows.schema)
    assert len(made) == len(groups) and max(s.bytes for s in made) <= target
    assert sorted(s.rows for s in made) == sorted(sum(s.rows for s in g) for g in groups)
    store.compact(target)
    last = store.manifest()
    assert len(S.plan_merges(last["shards"], target)) == 0 and max(s.bytes for s in last["shards"]) <= target
    assert sorted(map(tuple, store.read().collect())) == before
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "true"
    # A version that adds shards keeps the parts of the others.
    store.append(rows.limit(3))
    assert set(last["parts"]) <= set(store.manifest()["parts"])


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "x y " * 500_000, "s", "t"), (2, "a", "s", "t")], SCHEMA)
    assert {r["doc_id"]: r["n_bytes"] for r in S.shard_documents(df, target=1 << 16).collect()} == {1: 2_000_000, 2: 1}


def test_of_two_writers_one_fails(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/store")
    store.append(table(spark, 0, 5))
    seen = store.manifest()
    store.commit(seen, seen["schema"], seen["shards"])
    with pytest.raises(Py4JJavaError):
        store.commit(seen, seen["schema"], [])
    assert store.versions() == [1, 2] and store.read().count() == 5


def test_operator(spark):
    df = table(spark, 0, 50).unionAll(spark.createDataFrame([(3, "twice", "s", "t")] * 2, SCHEMA))
    got = S.shard_documents(df).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r["doc_id"] for r in df.collect()), key=str)
    rows = {r["shard"]: r["shard_rows"] for r in got}
    assert sum(rows.values()) == 52
    assert S.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
