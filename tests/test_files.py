"""Sinks and sources of files: whole or nothing, ranges that do not show, errors beside rows."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from cuewright.sources import files, srt


def listed(path):
    return sorted(p.name for p in path.iterdir())


def test_named_files(spark, tmp_path):
    rows = spark.range(1000).select(F.format_string("f%d.txt", F.col("id") % 7).alias("name"), "id", F.format_string("%d,", "id").alias("content"))
    files.write_named(rows.repartition(5), str(tmp_path / "out"), ("id",))
    assert listed(tmp_path) == ["out"] and listed(tmp_path / "out") == [f"f{k}.txt" for k in range(7)]
    assert (tmp_path / "out" / "f3.txt").read_text() == "".join(f"{i}," for i in range(3, 1000, 7))
    files.write_named(rows.where("id < 2"), f"file://{tmp_path}/out", ("id",))  # what was there is replaced
    assert listed(tmp_path / "out") == ["f0.txt", "f1.txt"]
    files.write_named(rows.limit(0), str(tmp_path / "none"), ("id",))
    assert listed(tmp_path / "none") == []


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(400).select(F.format_string("f%d.txt", F.col("id") % 5).alias("name"), "id", F.lit("x").alias("content"))
    files.write_named(rows.where("id < 5"), str(tmp_path / "out"), ("id",))

    def broken(batches):
        for batch in batches:
            if 250 in batch.column("id").to_pylist():
                raise RuntimeError("broken")
            yield batch

    files.register(spark)
    bad = rows.repartition("name").sortWithinPartitions("name", "id").mapInArrow(broken, rows.schema).select("name", F.col("content").cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("named_files").mode("overwrite").save(str(tmp_path / "out"))
    assert listed(tmp_path) == ["out"] and (tmp_path / "out" / "f0.txt").read_text() == "x"
    apart = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("a", b"3")], "name string, content binary").coalesce(1)
    for wrong in (apart, spark.createDataFrame([("../a", b"1")], "name string, content binary")):
        with pytest.raises(Exception, match="not a file name"):
            wrong.write.format("named_files").mode("overwrite").save(str(tmp_path / "other"))
    with pytest.raises(Exception, match="there already"):
        apart.limit(1).write.format("named_files").mode("append").save(str(tmp_path / "out"))
    assert listed(tmp_path) == ["out"]


def test_names_of_sources(spark, tmp_path):
    ids = ["a/b", "a_b", "a%2Fb", ".hidden", "x.y", "ü 1"]
    cues = spark.createDataFrame([(s, k * 10, k * 10 + 5, f"{s} {k}") for s in ids for k in range(3)], "source_id string, start_ms long, end_ms long, text string")
    srt.write(cues, str(tmp_path / "out"))
    assert len(listed(tmp_path / "out")) == len(ids)
    assert sorted(r["text"] for r in srt.parse(srt.read(spark, str(tmp_path / "out"))).collect()) == sorted(f"{s} {k}" for s in ids for k in range(3))


@pytest.mark.parametrize("split", [1, 3, 4, 7, 101, 1 << 20])
def test_any_split_gives_the_same_samples(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for k, size in enumerate([0, 1, 2, 3, 4, 5, 7, 8, 63 if split < 7 else 1999]):
        raw = rng.randbytes(size)
        raw = b"".join(struct.pack("<f", rng.random()) for _ in range(size // 4)) + raw[: size % 4]
        (tmp_path / f"{k}.pcm").write_bytes(raw)
        want[f"{k}.pcm"] = [struct.unpack_from("<f", raw, 4 * i)[0] for i in range(size // 4)]
    rows = files.read_pcm(spark, str(tmp_path), split).collect()
    got = {k: {} for k in want}
    for r in rows:
        for i, v in enumerate(r["samples"]):
            own = got[r["source_id"].rsplit("/", 1)[-1]]
            assert r["first_sample"] + i not in own
            own[r["first_sample"] + i] = v
    assert {k: [v for _, v in sorted(x.items())] for k, x in got.items()} == want and all(sorted(x) == list(range(len(x))) for x in got.values())


def test_long_rows_are_cut(spark, tmp_path):
    rows = spark.createDataFrame([("a.pcm", 0, [float(i % 1000) for i in range(150_000)])], "name string, n int, samples array<float>")
    files.write_named(files.pcm_bytes(rows), str(tmp_path / "out"), ("n",))
    got = files.read_pcm(spark, f"file://{tmp_path}/out").orderBy("first_sample").collect()
    assert [len(r["samples"]) for r in got] == [65_536, 65_536, 18_928] and got[2]["samples"][5] == float((131_072 + 5) % 1000)
    with pytest.raises(Exception, match="not there"):
        files.read_pcm(spark, str(tmp_path / "nothing")).count()
