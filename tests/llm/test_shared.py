"""Scratch tables: written, read back, cleared."""

from cuewright.llm import _shared as S


def test_written_and_cleared(spark):
    df = S.written(spark.range(5), "five")
    assert df.count() == 5 and S.scratch_dir(spark) in df.inputFiles()[0].replace("file:///", "file:///")
    S.clear_scratch(spark)
    assert S.written(spark.range(2), "two").count() == 2


def test_components(spark):
    from cuewright.llm.components import components

    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext, conf = Context, spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            S.scratch_dir(Session)
