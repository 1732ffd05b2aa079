"""Removal of lines that stand in several documents, by probing a perfect hash of the repeated lines.

A line's key is the line trimmed and in lower case. A document contributes each of its keys once, as a 128-bit hash.
Counted over all documents, the hashes of keys that several documents have are dealt to shards of a bounded number of
keys. Each shard becomes a minimal perfect hash with arrays beside it: a fingerprint of 64 bits, the number of documents
and the smallest id. Documents then ask about their keys: a question goes to its shard, where the arrays are read at the
key's number, and no two lines are ever joined. Keys that one document alone has are in no shard; their questions find
another fingerprint.

The questions of a shard are answered in as many parts as its counts say, each with a copy of the shard, so that a
line which a third of all documents have is not one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm import perfect_hash
from cuewright.llm._shared import small_batches, written

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 10
SHARD_KEYS = 1024
PART_QUESTIONS = 16_384
BATCH_ROWS = 4096
NO_ID = -(2**63)  # stands for a missing id, which comes before all others


def _key(line: str, least_chars: int) -> bytes | None:
    """The hash of a line's key; none if that is too short."""
    key = line.strip(BLANKS)
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= least_chars else None


def _halves(keys: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, k, t, text``: equal ``k`` and ``t`` are rows of the same id and, but for a hash, the same text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k, t, high, low``: a row for each distinct key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {_key(line, least_chars) for line in text.split("\n")} - {None}
                keys += own
                owner += [i] * len(own)
            at = pa.array(owner, pa.int64())
            halves = [pa.array(x.view(np.int64)) for x in _halves(keys)]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("t").take(at), *halves], names=["k", "t", "high", "low"])

    return _texts(docs, id_col, text_col).select("k", "t", "text").mapInArrow(run, "k long, t long, high long, low long")


def repeated_keys(keys: DataFrame) -> DataFrame:
    """``high, low, first, n``: the keys of two documents or more, with their smallest id and number of texts."""
    counted = keys.groupBy("high", "low").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))
    return counted.where("first <> last").drop("last")


def shards(repeated: DataFrame, n_shards: int, least_parts: int) -> DataFrame:
    """``shard, parts, data``: each shard's perfect hash and arrays, and into how many parts its questions are dealt."""

    def built(high: np.ndarray, low: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
        index = perfect_hash.PerfectHash.of(high.view(np.uint64), low.view(np.uint64))
        place = np.argsort(index.find(high.view(np.uint64), low.view(np.uint64)))
        return perfect_hash.to_bytes(index, first=first[place], counts=n[place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        at = None

        def closed() -> pa.RecordBatch:
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            parts = least_parts + int(arrays[3].sum()) // PART_QUESTIONS
            return pa.RecordBatch.from_pydict({"shard": [at], "parts": [parts], "data": [built(*arrays)]})

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("high", "low", "first", "n")]
            for begin, end in _spans(shard):
                if held and shard[begin] != at:
                    yield closed()
                    held.clear()
                at = int(shard[begin])
                held.append([c[begin:end] for c in columns])
        if held:
            yield closed()

    dealt = repeated.withColumn("shard", F.pmod("high", F.lit(n_shards)).cast("long")).repartition("shard").sortWithinPartitions("shard")
    return dealt.select("shard", "high", "low", "first", "n").mapInArrow(run, "shard long, parts long, data binary")


def _spans(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of rows over which all ``columns`` are the same."""
    if not len(columns[0]):
        return []
    changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    edges = [0, *changes.tolist(), len(columns[0])]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _answers(questions: DataFrame) -> DataFrame:
    """``k, t, key``: the questions ``shard, part, data, k, t, high, low``, each shard's own row first, about lines whose
    first document is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, arrays = None, None, {}
        for batch in batches:
            shard, part, is_data = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "is_data"))
            for begin, end in _spans(shard, part, is_data):
                here = (int(shard[begin]), int(part[begin]))
                if is_data[begin]:
                    at = here
                    index, arrays = perfect_hash.from_bytes(batch.column("data")[begin].as_py())
                elif here == at:  # else the shard has no keys
                    rows = batch.slice(begin, end - begin)
                    k, t, high, low = (rows.column(c).to_numpy() for c in ("k", "t", "high", "low"))
                    found = index.find(high.view(np.uint64), low.view(np.uint64))
                    drop = np.flatnonzero(found >= 0)
                    drop = drop[arrays["first"][found[drop]] != k[drop]]
                    both = np.stack([high[drop], low[drop]], axis=1).astype("<i8").tobytes()
                    keys = pa.array([both[16 * i : 16 * i + 16] for i in range(len(drop))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(k[drop]), pa.array(t[drop]), keys], names=["k", "t", "key"])

    return questions.mapInArrow(run, "k long, t long, key binary")


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k, t, keys``: for each text the keys whose lines it loses."""
    spark = docs.sparkSession
    keys = written(line_keys(docs, least_chars, id_col, text_col), "line-keys")
    repeated = written(repeated_keys(keys), "repeated-keys")
    n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
    # What only one document has is spread evenly over the shards; what many have adds to the parts of its own.
    least_parts = 1 + keys.count() // n_shards // PART_QUESTIONS
    index = shards(repeated, n_shards, least_parts)
    shard = F.pmod("high", F.lit(n_shards)).cast("long").alias("shard")
    hits = repeated.groupBy(shard).agg((F.lit(least_parts) + F.expr(f"sum(n) div {PART_QUESTIONS}")).alias("parts"))
    many = hits.where(F.col("parts") > least_parts)
    asked = keys.select("k", "t", "high", "low", shard).join(many, "shard", "left")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("k", "t"), F.coalesce("parts", F.lit(least_parts))))
    copies = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "data")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    both = copies.select("shard", "part", F.lit(True).alias("is_data"), "data", *none("long", "k", "t", "high", "low")).unionAll(
        asked.select("shard", "part", F.lit(False).alias("is_data"), *none("binary", "data"), "k", "t", "high", "low")
    )
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("is_data"))
    return _answers(dealt).groupBy("k", "t").agg(F.collect_list("key").alias("keys"))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row: its text without the lines that an earlier document has.

    A text is split at ``\\n``; a key is a line without the blanks at both ends, ``A-Z`` in lower case. Keys of
    ``least_chars`` code points or more that stand in two documents or more lose all their lines except those in the
    document of the smallest id, where all stay. Rows of one id are one document, those without an id are one that comes
    before all others; a null text is empty, and an empty text is one empty line. Ids are whole numbers. Texts are read
    whole; a text and its lines are in memory at once. Other columns of ``docs`` do not matter. No rows give no rows.
    """
    small_batches(docs.sparkSession, BATCH_ROWS)
    gone = repeated_lines(docs, least_chars, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                lines = text.split("\n")
                drop = set(keys or ())
                left = [x for x in lines if _key(x, least_chars) not in drop] if drop else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append("\n".join(left))
            columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_col, "n_lines", "n_dropped", "kept"])

    found = _texts(docs, id_col, text_col).join(gone, ["k", "t"], "left").select("id", "text", "keys")
    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"{id_col} {kind}, n_lines long, n_dropped long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """``dedup`` with the SHA-256 digest of the text that is kept in its place."""
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
