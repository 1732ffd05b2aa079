"""Repeated byte strings through two-stage suffix sorting.

Every ``length``-byte window of every text is to be compared with every other. Windows are dealt out
by a local anchor: of the ``gram``-byte strings in a window the one with the least hash, the first
of equals. Equal windows have equal anchors, so windows that follow each other under one anchor form
a segment, and only segments of one anchor need comparing:

* an anchor that occurs once is dropped, which leaves little of a clean corpus;
* of segments of one anchor that are the same by length and a 128-bit hash of their bytes two are kept, wherever there
  are more: what the order finds of those two holds for all;
* the segments of one anchor are laid end to end (many anchors a block) and suffix sorted
  in two stages: suffixes smaller than their successors are sorted directly, all others are induced
  from them by scanning the buckets of first bytes in order. Neighbours in that order that share
  ``length`` bytes are repeats;
* an anchor with more than ``crowd`` distinct segments, such as the edge of a passage that very many
  texts quote, would fill more than one block. Its windows are counted by a 128-bit hash instead,
  which spreads over the cluster and sums before it moves.

Only windows that start a suffix are sorted; order beyond ``length`` bytes is not needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches, written

LENGTH = 400
GRAM = 128
CROWD = 512
BLOCK = 1 << 20
PIECE = 1 << 20
PAIRS = 2048
CHANCE = 24
_POSITION = np.uint64((1 << 24) - 1)


class _Roller:
    """Hashes of all substrings of a given length, from sums of powers modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, size=256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)]), dtype=np.uint64) for x in (self.base, self.inverse))
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.table[data] * self.down[: n - 1], dtype=np.uint64, out=out[1:])
        return out

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        return _mixed((sums[length:] - sums[:-length]) * self.up[: len(sums) - length])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_ROLLERS: dict[int, _Roller] = {}


def _roller(seed: int) -> _Roller:
    if seed not in _ROLLERS:
        _ROLLERS[seed] = _Roller(seed)
    return _ROLLERS[seed]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays (text, start, run, key, digest, more): ``run`` windows of ``length`` bytes from ``start``; the last
    two are a 128-bit hash of the segment's bytes."""
    lists: list[list[np.ndarray]] = [[] for _ in range(6)]
    block: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal block, held
        if block:
            for to, found in zip(lists, _block_segments(block, length, gram), strict=True):
                to.append(found)
        block, held = [], 0

    for number, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            piece = text[at : at + PIECE]
            block.append((number, at, piece))
            held += len(piece)
            if held >= BLOCK:
                flush()
            if at + PIECE >= len(text):
                break
            at += len(piece) - length + 1
    flush()
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in lists)


def _block_segments(block: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    joined = b"".join(b for _, _, b in block)
    data = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(b) for _, _, b in block], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    first = _roller(1)
    sums = first.sums(data)
    grams = first.all(sums, gram)
    marked = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = _least(marked, length - gram + 1)
    inside = np.zeros(len(least) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    ends = np.minimum(starts + sizes - length + 1, len(least))
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new[starts[starts < len(new)]] = True
    new &= inside
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    run = stop - begin
    own = np.searchsorted(starts, begin, side="right") - 1
    digests = b"".join(xxhash.xxh3_128_digest(joined[a : b + length - 1]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True))
    digest = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    key = grams[(least[begin] & _POSITION).astype(np.int64)]
    number = np.array([n for n, _, _ in block], dtype=np.int64)
    offset = np.array([o for _, o, _ in block], dtype=np.int64)
    return number[own], begin - starts[own] + offset[own], run, key.view(np.int64), digest[:, 0], digest[:, 1]


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as a number whose order is that of the bytes."""
    n = len(data) - 7
    out = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        out |= data[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _same(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of positions have the same ``length`` bytes, some pairs at a time."""
    whole = np.ndarray(len(data) - length + 1, dtype=f"V{length}", buffer=data, strides=(1,))
    out = np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), PAIRS):
        a, b = (whole[x[at : at + PAIRS]].view(np.uint8).reshape(-1, length) for x in (left, right))
        out[at : at + PAIRS] = (a == b).all(axis=1)
    return out


def _sort_directly(at: np.ndarray, data: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the ``depth`` bytes that follow them, eight at a time; only ties go on, and
    after ``CHANCE`` bytes only those that are not the same in all."""
    order = at[np.argsort(words[at], kind="stable")]
    first = np.ones(len(order), dtype=bool)
    first[1:] = words[order[1:]] != words[order[:-1]]
    active = np.arange(len(order))
    for step in range(8, depth, 8):
        single = first & np.append(first[1:], True)
        active, first = active[~single], first[~single]
        if step == CHANCE and len(active):
            differs = np.zeros(len(active), dtype=bool)
            differs[1:] = ~first[1:]
            later = np.flatnonzero(differs)
            differs[later] = ~_same(data, order[active[later - 1]], order[active[later]], depth)
            mixed = np.logical_or.reduceat(differs, np.flatnonzero(first))[np.cumsum(first) - 1]
            active, first = active[mixed], first[mixed]
        if not len(active):
            break
        key = words[np.minimum(order[active] + step, len(words) - 1)]
        differs = np.zeros(len(active), dtype=bool)
        differs[1:] = (key[1:] != key[:-1]) & ~first[1:]
        if not differs.any():
            continue
        group = np.cumsum(first) - 1
        torn = np.zeros(group[-1] + 1, dtype=bool)
        torn[group[differs]] = True
        some = np.flatnonzero(torn[group])
        sorting = np.lexsort((key[some], group[some]))
        order[active[some]] = order[active[some]][sorting]
        key[some] = key[some][sorting]
        first[1:] |= key[1:] != key[:-1]
    return order


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` positions (a mask) of ``data`` in the order of the suffixes that start there, of
    which ``depth`` bytes count. ``data`` must end in ``depth + 16`` bytes that are not wanted.
    """
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    ending = np.searchsorted(change, np.arange(n), side="left")
    rising = np.ones(n, dtype=bool)  # smaller than its successor
    known = ending < len(change)
    at = change[ending[known]]
    rising[known] = data[at + 1] > data[at]
    # What is wanted up to the next rising suffix is kept as well: the rest is induced from there.
    kept = wanted.copy()
    following = np.where(rising, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    tail = np.flatnonzero(wanted[:-1] & ~wanted[1:]) + 1
    for a, b in zip(tail.tolist(), following[tail].tolist(), strict=True):
        kept[a : b + 1] = True
    words = _words(data)
    direct = _sort_directly(np.flatnonzero(kept & rising), data, words, depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    falling = kept & ~rising
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.unique(data[kept]).tolist():
        parts, waves = induced[c], []
        wave = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        while len(wave):
            waves.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[falling[wave] & (data[wave] == c)]
        bucket = np.concatenate([*waves, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        back = back[falling[back] & (data[back] > c)]
        heads = data[back]
        back = back[np.argsort(heads, kind="stable")]
        edges = np.searchsorted(data[back], np.arange(257))
        for x in np.unique(heads).tolist():
            induced[x].append(back[edges[x] : edges[x + 1]])
    order = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For neighbours in ``order``, the bytes they share, up to ``most``."""
    out = np.full(max(0, len(order) - 1), most, dtype=np.int64)
    words = _words(data)
    left, right, pair = order[:-1], order[1:], np.arange(len(out))
    for step in range(0, most, 8):
        if step == CHANCE:  # copies share all
            apart = ~_same(data, left, right, most)
            left, right, pair = left[apart], right[apart], pair[apart]
        x = words[np.minimum(left + step, len(words) - 1)] ^ words[np.minimum(right + step, len(words) - 1)]
        apart = x != 0
        if apart.any():
            zeros = np.zeros(apart.sum(), dtype=np.int64)
            y = x[apart]
            for j in range(1, 8):
                zeros += y < (np.uint64(1) << np.uint64(64 - 8 * j))
            out[pair[apart]] = np.minimum(step + zeros, most)
            same = ~apart
            left, right, pair = left[same], right[same], pair[same]
        if not len(pair):
            break
    return out


def repeated_windows(pieces: list[bytes], runs: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each segment the maximal ranges of window starts whose window starts anywhere else too."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces) + bytes(length + 16), dtype=np.uint8)
    wanted = np.zeros(len(data), dtype=bool)
    for a, r in zip(starts.tolist(), runs, strict=True):
        wanted[a : a + r] = True
    order = two_stage_order(data, wanted, length)
    equal = common_prefixes(data, order, length) >= length
    twice = np.zeros(len(data), dtype=bool)
    twice[order[:-1][equal]] = True
    twice[order[1:][equal]] = True
    return [_ranges(twice[a : a + r]) for a, r in zip(starts.tolist(), runs, strict=True)]


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _run_ends(at: str) -> list[Column]:
    """First places, and those behind the last, of the runs in an array of rising numbers: ``a``, ``b``."""
    begins = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    lasts = F.filter(at, lambda x, i: F.get(at, i + 1).isNull() | (F.get(at, i + 1) != x + 1))
    return [begins.alias("a"), F.transform(lasts, lambda x: x + 1).alias("b")]


SAME = ["key", "digest", "more", "run"]  # what identical segments share
_SAME_TYPES = ", ".join(f"{c} long" for c in SAME)
_MARKS = f"{_SAME_TYPES}, marks array<struct<a:long,b:long>>"
_MARK_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _marks_batch(rows: list[tuple[int, ...]], marks: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(SAME))]
    values = pa.array([[{"a": a, "b": b} for a, b in m] for m in marks], _MARK_TYPE)
    return pa.RecordBatch.from_arrays([*columns, values], names=[*SAME, "marks"])


def _spans(docs: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """``id, rid, spans array<struct<a,b>>``: repeated byte ranges of the rows that have any.

    ``docs`` is ``id, rid, text binary``; ``rid`` tells rows with one id and different texts apart.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, *found = segments([t or b"" for t in batch.column(2).to_pylist()], length, gram)
            at = pa.array(text, pa.int64())
            names = ["id", "rid", "start", "run", "key", "digest", "more"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in found)], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    found = written(docs.mapInArrow(find, f"id {kind}, rid long, start long, run long, key long, digest long, more long"), "segments")
    # Counts are written before they are joined: both sides of the join are then plain shuffles, of which
    # a hot key's partition can be split.
    often = written(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
    shared = written(found.join(often.hint("merge"), "key", "left_semi"), "shared")
    place = F.struct("id", "rid", "start")
    distinct = shared.groupBy(*SAME).agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other"))
    distinct = written(distinct, "distinct")
    crowds = written(distinct.groupBy("key").agg(F.count("*").alias("kinds")), "crowds")
    both = F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one"))
    compared = distinct.join(crowds.hint("merge"), "key").select(*SAME, "n", F.posexplode(both).alias("copy", "at"), (F.col("kinds") > crowd).alias("crowded"))
    compared = compared.where("copy = 0 or not crowded").select(*SAME, "n", F.col("copy").cast("long").alias("copy"), "at.*", "crowded")

    asked = compared.groupBy("id", "rid").agg(F.collect_list(F.struct(*SAME, "copy", "n", "start", "crowded")).alias("asked"))
    asked = asked.withColumnsRenamed({"id": "a_id", "rid": "a_rid"})
    # One row for each asking id and text: of repeated rows any one serves.
    texts = docs.join(asked, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("rid") == F.col("a_rid"))).select("text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*SAME, "copy", "n", "crowded", "bytes"]
        for batch in batches:
            rows = []
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(*(w[c] for c in (*SAME, "copy", "n")), w["crowded"], text[w["start"] : w["start"] + w["run"] + length - 1]) for w in wants]
            kinds = [pa.int64()] * (len(SAME) + 2) + [pa.bool_(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    pieces = written(texts.mapInArrow(cut, f"{_SAME_TYPES}, copy long, n long, crowded boolean, bytes binary"), "pieces")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, ...], bytes] = {}
        size = 0
        last = None
        for batch in batches:
            for *own, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment = tuple(own)
                if size >= BLOCK and segment[0] != last:
                    yield marked(held)
                    held, size = {}, 0
                last = segment[0]
                if segment not in held:  # repeated rows bring a segment twice
                    held[segment] = raw
                    size += len(raw)
        if held:
            yield marked(held)

    def marked(held: dict[tuple[int, ...], bytes]) -> pa.RecordBatch:
        found = repeated_windows(list(held.values()), [run for *_, run, _ in held], length)
        own = {segment: marks for segment, marks in zip(held, found, strict=True) if not segment[-1]}
        return _marks_batch(list(own), list(own.values()))

    calm = pieces.where("not crowded").select(*SAME, "copy", "bytes").repartition("key").sortWithinPartitions("key")
    sorted_marks = calm.mapInArrow(compare, _MARKS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run = own[len(SAME) - 1]
                data = np.frombuffer(raw, dtype=np.uint8)
                ends = [_roller(s).all(_roller(s).sums(data), length).view(np.int64) for s in (3, 4)]
                columns = [pa.array(np.full(run, x), pa.int64()) for x in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(run), pa.int64()), *(pa.array(e, pa.int64()) for e in ends)], names=[*SAME, "n", "at", "h", "g"])

    windows = pieces.where("crowded").select(*SAME, "n", "bytes").dropDuplicates(SAME).mapInArrow(hashed, f"{_SAME_TYPES}, n long, at long, h long, g long")
    repeated = windows.groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g")
    crowd_marks = windows.join(repeated, ["h", "g"], "left_semi").groupBy(*SAME).agg(F.array_sort(F.collect_list("at")).alias("at"))
    crowd_marks = crowd_marks.select(*SAME, *_run_ends("at")).select(*SAME, F.arrays_zip("a", "b").alias("marks"))

    marks = written(sorted_marks.unionByName(crowd_marks).where("size(marks) > 0"), "marks")
    moved = F.transform("marks", lambda m: F.struct((F.col("start") + m["a"]).alias("a"), (F.col("start") + m["b"] + (length - 1)).alias("b")))
    own = shared.join(marks, SAME).select("id", "rid", moved.alias("spans"))
    return own.groupBy("id", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """``text`` without the union of ``spans``; bytes removed and maximal runs of them."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            kept.append(text[at:a])
        if b > end:
            removed += b - max(a, end)
            end = at = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, crowd: int) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).cast("binary").alias("text"))
    spans = _spans(slim, length, gram, crowd).withColumnsRenamed({"id": "s_id", "rid": "s_rid"})
    return slim.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("rid") == F.col("s_rid")), "left").select("id", "text", "spans")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``,
    ``kept binary``: the bytes that stay. A text may be of any length: it is searched in overlapping pieces.

    Every byte covered by a ``length``-byte string that also starts anywhere else in the input, the
    same text included, is removed; overlaps count, and strings are judged on the input. Null texts
    count as empty; texts shorter than ``length`` keep all. Repeated rows repeat each other's
    strings; null ids are ids like any other. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                kept, removed, runs = without(text, [(s["a"], s["b"]) for s in spans or ()])
                rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] * texts)))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * texts
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds) + 1])

    kind = docs.schema[id_col].dataType.simpleString()
    out = _with_spans(docs, id_col, text_col, length, gram, crowd).mapInArrow(finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
    return out.withColumnRenamed("id", id_col)
