"""Files by name as a sink, and sample files cut into ranges as a source: two of Spark's Python data sources.

``register`` makes the formats ``named_files`` and ``pcm`` known to a session. Both reach the store by the path's scheme, so it
must be one that the workers can open: local and shared folders, object stores, HDFS with its library.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SAMPLE_BYTES = 4
ROW_SAMPLES = 65_536
SPLIT_BYTES = 32 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    files: int


class NamedFilesWriter(DataSourceWriter):
    """Writes into a folder beside the target, which takes the target's place when all tasks are done.

    A task writes each file under a name of its attempt and gives it its own name once it is whole, so an attempt that
    fails leaves no file behind, and one that is repeated replaces what was there. A job that fails takes the folder away.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}.__{uuid.uuid4().hex}"
        store, place = _store(self.path)
        if not overwrite and store.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{path} is there already")
        store.create_dir(_store(self.staged)[1], recursive=True)  # here only: no late attempt brings a folder back

    def write(self, iterator: Iterator) -> Written:
        store, folder = _store(self.staged)
        attempt = uuid.uuid4().hex
        seen: set[str] = set()
        name, out = None, None

        def finish() -> None:
            if out is not None:
                out.close()
                store.move(f"{folder}/.{attempt}", f"{folder}/{name}")

        try:
            for row in iterator:
                if row["name"] != name:
                    finish()
                    out = None
                    name = row["name"]
                    if name in seen or not name or "/" in name or name.startswith("."):
                        raise ValueError(f"not a file name, or its rows do not follow one another: {name!r}")
                    seen.add(name)
                    out = store.open_output_stream(f"{folder}/.{attempt}")
                out.write(bytes(row["content"]))
            finish()
        except BaseException:
            if out is not None:
                out.close()
            if store.get_file_info(f"{folder}/.{attempt}").type != fs.FileType.NotFound:
                store.delete_file(f"{folder}/.{attempt}")
            raise
        return Written(len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        store, staged = _store(self.staged)
        _, place = _store(self.path)
        old = f"{place}.__old_{uuid.uuid4().hex}"
        if there := store.get_file_info(place).type != fs.FileType.NotFound:
            store.move(place, old)
        store.move(staged, place)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, staged = _store(self.staged)
        for tries in range(5):  # an attempt that is being stopped may still write
            if store.get_file_info(staged).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(staged)
            except OSError:
                if tries == 4:
                    raise


class NamedFiles(DataSource):
    """``name string, content binary``: a file for each name under the path, the contents of its rows one behind the other.
    The rows of a name follow one another in one partition."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


@dataclass
class Range(InputPartition):
    """The bytes of a file from ``start`` to before ``end``."""

    path: str
    size: int
    start: int
    end: int


class PcmReader(DataSourceReader):
    """Little-endian 32-bit floats. A sample belongs to the range in which it begins, so a range begins behind the 1 to 3 bytes
    that it finishes for the one before it, and reads as many beyond its own end. A sample that the file cuts off goes."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def partitions(self) -> list[Range]:
        store, place = _store(self.path)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} is not there")
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(place, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [
            Range(scheme + x.path, x.size, a, min(a + self.split, x.size))
            for x in sorted(found, key=lambda x: x.path)
            for a in range(0, x.size, self.split)
        ]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, place = _store(part.path)
        up = lambda n: -(-n // SAMPLE_BYTES) * SAMPLE_BYTES
        at, end = up(part.start), min(up(part.end), part.size // SAMPLE_BYTES * SAMPLE_BYTES)
        with store.open_input_file(place) as data:
            data.seek(min(at, part.size))
            while at < end:
                raw = data.read(min(ROW_SAMPLES * SAMPLE_BYTES, end - at))
                if len(raw) % SAMPLE_BYTES or not raw:
                    raise OSError(f"{part.path} is shorter than it was")
                samples = pa.array([np.frombuffer(raw, "<f4")], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([at // SAMPLE_BYTES], pa.int64()), samples], names=["source_id", "first_sample", "samples"])
                at += len(raw)


class Pcm(DataSource):
    """``source_id, first_sample, samples``: the samples of each file under the path in rows of bounded length, the first one's
    number beside them. Option ``splitBytes``: the bytes of a file that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "source_id string, first_sample long, samples array<float>"

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
    spark.dataSource.register(Pcm)


def write_named(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """``rows(name, content, order ...)`` as files under ``path``, which is replaced: a name's contents in ``order``.
    A name is one file, which one task writes as its rows come; no row is held."""
    register(rows.sparkSession)
    dealt = rows.repartition("name").sortWithinPartitions("name", *order)
    dealt.selectExpr("name", "cast(content as binary) as content").write.format("named_files").mode("overwrite").save(path)


def read_pcm(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``source_id, first_sample, samples`` of a file or a folder of files, ``split_bytes`` a task."""
    register(spark)
    return spark.read.format("pcm").option("splitBytes", str(split_bytes)).load(path)


def file_stem(source_id: Column) -> Column:
    """A source's id as a name that a file can have, another one for every id."""
    plain = F.replace(F.replace(source_id.cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.regexp_replace(plain, r"^\.", "%2E")


def pcm_bytes(rows: DataFrame) -> DataFrame:
    """``rows(name, ..., samples array<float>)`` with ``content``, the samples as little-endian 32-bit floats, in their place."""
    kept = [c for c in rows.columns if c != "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("samples")
            raw = [b"" if x is None else np.asarray(x, "<f4").tobytes() for x in (v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in lists)]
            yield batch.select(kept).append_column("content", pa.array(raw, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "samples")
    return rows.select(*kept, "samples").mapInArrow(run, f"{fields}, content binary")
