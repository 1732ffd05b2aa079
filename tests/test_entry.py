"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["source_id", "index", "start", "end", "text"] and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["strip_punct", "vad_segments", "lookup", "srt_roundtrip", "training_mix", "subtitle_checks", "vad_capped", "subtitles", "transcript_counters", "training_set", "collapse_turns", "wrap_text", "srt_strict"])
def test_oracles(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in "documents conversations events benchmark labels".split():
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
