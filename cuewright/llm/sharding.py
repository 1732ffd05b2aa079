"""Shards by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction looks at sizes only: shards of a
similar size, that is of one tier (sizes within a factor of ``FAN``), are merged once there are enough of
them, into runs that fill a target-sized file. A merge is one task that reads its inputs and writes
one file; nothing is shuffled, and a job holds many merges. What exists is what the newest manifest lists:
a manifest is written beside the others under a name of its own and renamed to the next version without
overwriting, so a reader sees the old version or the new one, and of two writers one fails and may retry.

A manifest names its parts, files that list up to ``PART_SHARDS`` shards each; a version writes only the
parts that it changes. The driver handles a row for each shard, never rows of data; ``ARRIVAL_ROWS`` and
``TARGET`` set how many shards a table has.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm._shared import scratch_dir

TARGET = 24 << 20
ARRIVAL_ROWS = 4096
FAN = 4
FLOOR = 64 << 10
MERGES_PER_JOB = 64
JOBS_AT_ONCE = 4
PART_SHARDS = 10_000


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    bytes: int
    rows: int
    tier: int


def tier_of(size: int) -> int:
    """0 for sizes up to ``FLOOR``, then one more for each factor of ``FAN``."""
    return max(0, math.ceil(math.log(max(size, 1) / FLOOR, FAN)))


def plan_merges(shards: list[Shard], target: int = TARGET, fan: int = FAN) -> list[list[Shard]]:
    """Groups to merge: within a tier that has ``fan`` shards under the target or more, runs of similar
    size are packed, largest first, until the next would pass the target. Groups of one stay."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes <= target // 2:
            tiers.setdefault(s.tier, []).append(s)
    out = []
    for _, own in sorted(tiers.items()):
        if len(own) < fan:
            continue
        group: list[Shard] = []
        held = 0
        for s in sorted(own, key=lambda x: (-x.bytes, x.path)):
            if group and held + s.bytes > target:
                out.append(group)
                group, held = [], 0
            group.append(s)
            held += s.bytes
        out.append(group)
    return [g for g in out if len(g) > 1]


class Store:
    """A table of immutable shards under ``root``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _listing(self, folder: str) -> dict[str, int]:
        return {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(self._path(f"{self.root}/{folder}"))}

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._listing("manifests") if n.startswith("v") and n.endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _store(self, name: str, body: dict) -> None:
        stream = self._fs.create(self._path(f"{self.root}/manifests/{name}"), False)
        stream.write(json.dumps(body).encode())
        stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """The given or newest manifest; an empty one at version 0 if there is none. ``parts`` are the names of
        its parts with the shards that each lists, ``shards`` all of them."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "parts": {}, "shards": []}
        found = self._load(f"v{known[-1] if version is None else version:08d}.json")
        parts = {name: [Shard(**s) for s in self._load(name)["shards"]] for name in found["parts"]}
        return found | {"parts": parts, "shards": [s for own in parts.values() for s in own]}

    def commit(self, before: dict, schema: str, shards: list[Shard]) -> int:
        """Make ``shards`` the table; fails if another version came after ``before``. Parts whose shards all
        stay are kept, all other shards go to new parts."""
        version = before["version"] + 1
        now = set(shards)
        kept = {name: own for name, own in before["parts"].items() if now.issuperset(own)}
        rest = sorted(now.difference(*kept.values()), key=lambda s: s.path)
        names = list(kept)
        for at in range(0, len(rest), PART_SHARDS):
            names.append(f"part-{uuid.uuid4().hex}.json")
            self._store(names[-1], {"shards": [asdict(s) for s in rest[at : at + PART_SHARDS]]})
        temp = f".{uuid.uuid4().hex}"
        self._store(temp, {"version": version, "schema": schema, "parts": names})
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        no_overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        no_overwrite[0] = rename.NONE
        self._context.rename(self._path(f"{self.root}/manifests/{temp}"), self._path(f"{self.root}/manifests/v{version:08d}.json"), no_overwrite)
        return version

    def _shards(self, folder: str, schema: T.StructType) -> list[Shard]:
        """The shards in a folder just written; files without rows are not listed."""
        sizes = {n: b for n, b in self._listing(folder).items() if n.startswith("part-")}
        if not sizes:
            return []
        read = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        rows = {r["name"]: r["n"] for r in read.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()}
        return [Shard(f"{folder}/{n}", b, rows[n], tier_of(b)) for n, b in sorted(sizes.items()) if rows.get(n)]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Add ``df`` as small shards of at most ``rows`` rows and commit. Nothing to add: still a version."""
        before = self.manifest()
        folder = f"arrivals-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        schema = before["schema"] or df.schema.json()
        return self.commit(before, schema, [*before["shards"], *self._shards(folder, df.schema)])

    def _merged(self, groups: list[list[Shard]], schema: T.StructType) -> list[Shard]:
        """One file for each of ``groups``, by one job with a task for each.

        A union whose parts are single partitions would itself become a single partition. That is turned
        off in a session of its own, so that the caller's settings stay as they are.
        """
        session = self.spark.newSession()
        session.conf.set("spark.sql.unionOutputPartitioning", "false")
        folder = f"merged-{uuid.uuid4().hex}"
        parts = [session.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in g)).coalesce(1) for g in groups]
        reduce(DataFrame.unionAll, parts).write.parquet(f"{self.root}/{folder}")
        made = self._shards(folder, schema)
        if len(made) != len(groups) or sum(s.rows for s in made) != sum(s.rows for g in groups for s in g):
            raise RuntimeError("a merge lost or repeated rows; the version before stays")
        return made

    def compact(self, target: int = TARGET, fan: int = FAN) -> int:
        """Merge until no tier holds ``fan`` shards that can be merged; every round is one commit. Several
        jobs run at once."""
        while True:
            before = self.manifest()
            merges = plan_merges(before["shards"], target, fan)
            if not merges:
                return before["version"]
            schema = T.StructType.fromJson(json.loads(before["schema"]))
            jobs = [merges[at : at + MERGES_PER_JOB] for at in range(0, len(merges), MERGES_PER_JOB)]
            with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
                made = [s for found in pool.map(lambda groups: self._merged(groups, schema), jobs) for s in found]
            gone = {s.path for g in merges for s in g}
            self.commit(before, before["schema"], [*(s for s in before["shards"] if s.path not in gone), *made])

    def expire(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` manifests, and the parts and shards that only those list."""
        known = self.versions()
        files = lambda m: {*(f"manifests/{n}" for n in m["parts"]), *(s.path for s in m["shards"])}
        listed = set().union(*(files(self.manifest(v)) for v in known[-keep:]))
        gone = set().union(*(files(self.manifest(v)) for v in known[:-keep])) - listed
        # Manifests go first: a version that is listed always has its files.
        for path in [*(f"manifests/v{v:08d}.json" for v in known[:-keep]), *sorted(gone)]:
            self._fs.delete(self._path(f"{self.root}/{path}"), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the newest by default, with ``_metadata`` to tell its shards."""
        found = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        if not found["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in found["shards"]))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, target: int = TARGET) -> DataFrame:
    """Append ``docs`` to a store at ``root`` (a new one by default), compact it, and say where each
    row lies: ``id_col, shard, tier, shard_rows, n_bytes`` from the newest manifest's files.

    Every row is in exactly one shard, repeated rows as often as they come; all columns, nulls
    included, are stored as they are, texts of any length whole (a row is never split, so a shard of one
    very long text may pass the target); null texts have null ``n_bytes``. No rows: no shards, no result rows.
    """
    spark = docs.sparkSession
    store = Store(spark, root or f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(docs)
    store.compact(target)
    store.expire()
    shards = store.manifest()["shards"]
    out = store.read().select(F.col(id_col), F.octet_length(text_col).cast("long").alias("n_bytes"), *([F.col("_metadata.file_name").alias("shard")] if shards else [F.lit("").alias("shard")]))
    listed = spark.createDataFrame([(s.path.rsplit("/", 1)[1], s.tier, s.rows) for s in shards], "shard string, tier int, shard_rows long")
    return out.join(listed, "shard").select(id_col, "shard", "tier", "shard_rows", "n_bytes")
