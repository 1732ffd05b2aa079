"""Byte-level BPE from given ranks, with a segment tree over byte positions.

The tree's leaf i holds the rank of the pair that starts at byte i, or a rank beyond all others
where no live pair starts. Nodes have 32 children, of which they hold the least rank, so the way
from the root to the first child of that rank ends at the leftmost pair of least rank. A merge
changes the pairs at two live neighbours and removes one, each in logarithmic time, so a piece of
n bytes takes O(n log n) whatever its content; a short piece's tree is its row of leaves.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches

KEEP_PIECES = 400_000
KEEP_CHARS = 48
_FAN = 32
_NONE = 1 << 40


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A ``token rank`` file, base64 tokens, read by Spark so that it may lie in any store; its size
    is that of the vocabulary, whatever the data."""
    uri = path if "://" in path else f"file://{path}"
    # Read on the driver: the file is local to it and is sent to the workers in a broadcast.
    if uri.startswith("file://"):
        with open(uri[7:], "rb") as lines:
            rows = [line.split() for line in lines]
    else:
        rows = [r["value"].encode().split() for r in spark.read.text(uri).collect()]
    return {base64.b64decode(r[0]): int(r[1]) for r in rows if r}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece: the adjacent pair of least rank merges first, leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    leaves = [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > _FAN:
        below = levels[-1]
        levels.append([min(below[i : i + _FAN]) for i in range(0, len(below), _FAN)])
    root, inner, upper = levels[-1], levels[-2::-1], levels[1:]
    after = list(range(1, n + 2))  # the start of the next live token
    before = list(range(-1, n))
    while root and (least := min(root)) < _NONE:
        i = root.index(least)
        for level in inner:
            i = level.index(least, i * _FAN)
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        leaves[i] = get(piece[i : after[end]], _NONE) if end < n else _NONE
        if gone < n - 1:
            leaves[gone] = _NONE
        left = before[i]
        if left >= 0:
            leaves[left] = get(piece[left:end], _NONE)
        if upper:
            for at in (i, gone, left):
                below = leaves
                for level in upper:
                    at //= _FAN
                    if not 0 <= at < len(level) or level[at] == (low := min(below[at * _FAN : at * _FAN + _FAN])):
                        break
                    level[at] = low
                    below = level
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


# Classes of the `regex` syntax and what the standard library calls them.
_PLAIN_CLASSES = ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"))


@functools.cache
def _odd_points() -> frozenset[str]:
    """Code points that the two columns of ``_PLAIN_CLASSES``, or the two meanings of white space, tell apart."""
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    pairs = [(regex.compile(a), re.compile(b)) for a, b in (*_PLAIN_CLASSES, (r"\p{White_Space}", r"\s"))]
    return frozenset().union(*(set(a.findall(points)) ^ set(b.findall(points)) for a, b in pairs))


class Splitter:
    """All matches of a pattern with Unicode classes, by the standard library's faster matcher where
    the text holds no code point on which the two differ, else by the ``regex`` package."""

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern)
        for theirs, ours in _PLAIN_CLASSES:
            pattern = pattern.replace(theirs, ours)
        self.fast = None if r"\p" in pattern else re.compile(pattern)
        self.odd = _odd_points()

    def __call__(self, text: str) -> list[str]:
        if self.fast and self.odd.isdisjoint(set(text)):
            return self.fast.findall(text)
        return self.exact.findall(text)


class _Known(dict):
    """Joined ids of the pieces met so far; of two generations the older is dropped when both are full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> str:
        found = self.old.get(piece) or self.make(piece)
        if len(piece) <= KEEP_CHARS:
            if len(self) >= KEEP_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Encodes and decodes whole texts; remembers the tokens of short pieces, in bounded number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, Splitter(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.spelled = {str(i): t for t, i in ranks.items()}
        self.known = _Known(lambda piece: ",".join(map(str, merge(piece.encode(), ranks))))

    def encode_joined(self, text: str) -> str:
        """The ids of ``text`` in decimal, joined by commas."""
        return ",".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, joined.split(","))) if joined else b""


def _mapped(docs: DataFrame, ranks: dict[bytes, int], pattern: str, out: str, row, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    sent, mark = docs.sparkSession.sparkContext.broadcast(ranks), _mark(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern, mark)
        for batch in batches:
            rows = [row(codec, (t or b"").decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS[out], strict=True)] if rows else [pa.array([], k) for k in _KINDS[out]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *_NAMES[out]])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_IDS = "ids array<int>"
_NAMES = {_DIGESTS: ["n_tokens", "ids_sha256", "decoded_sha256"], _IDS: ["ids"]}
_KINDS = {_DIGESTS: [pa.int64(), pa.string(), pa.string()], _IDS: [pa.list_(pa.int32())]}
_CODECS: dict[tuple, Codec] = {}


def _mark(ranks: dict[bytes, int]) -> bytes:
    """A digest of a whole vocabulary."""
    whole = hashlib.blake2b(digest_size=16)
    for token, rank in sorted(ranks.items()):
        whole.update(b"%d:%d:%b" % (rank, len(token), token))
    return whole.digest()


def _codec(ranks: dict[bytes, int], pattern: str, mark: bytes) -> Codec:
    """One codec for each worker process and vocabulary, kept between tasks with what it has learnt."""
    key = (mark, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for every row; null and empty texts give an empty array."""
    return _mapped(docs, ranks, pattern, _IDS, lambda codec, text: (codec.encode(text),), id_col, text_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str = ".", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text_col``, the text of its ids; null ids give a null text. Bytes that do
    not form UTF-8, which only a cut sequence has, become replacement characters."""
    sent, mark = encoded.sparkSession.sparkContext.broadcast(ranks), _mark(ranks)
    schema = encoded.withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern, mark)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select([c for c in batch.schema.names if c != text_col]).columns, pa.array(texts, pa.string())], names=[*(c for c in batch.schema.names if c != text_col), text_col])

    out = [f for f in schema.fields if f.name != text_col] + [schema[text_col]]
    return encoded.mapInArrow(run, type(schema)(out))


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` for every row, repeated rows and null ids
    included. Null texts count as empty: no tokens, digests of the empty string. Texts of any length are
    encoded whole. Other columns are not read."""

    def row(codec: Codec, text: str) -> tuple[int, str, str]:
        joined = codec.encode_joined(text)
        back = codec.decode_joined(joined)
        return joined.count(",") + bool(joined), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    return _mapped(docs, ranks, pattern, _DIGESTS, row, id_col, text_col)
