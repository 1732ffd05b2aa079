"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's words form one line: its documents in a fixed pseudo-random order, end to end. The line
is cut into blocks. A source's target says how many block draws the mix takes from it; each pass
over the source permutes its blocks anew and a partial pass takes the first ones, the last of them
in part, so that the words taken meet the target exactly. The tree starts with every source's
number of draws, splits the output shards in two halves and deals the draws by a multivariate
hypergeometric sample to the halves, down to single shards. So every shard holds an exact quota
of each source, takes its own run of the permuted draws, and orders what it holds by itself.

Nobody holds the whole tree. A node's deal is drawn from the seed and the node's place alone, so a task walks from the
root to the shards that its own rows fall into, and there is no bound on the number of shards.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm._shared import small_batches, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240607
BLOCK_WORDS = 4096
BLOCKS_PER_SOURCE = 64
SHARD_WORDS = 4_000_000
BUCKET_ROWS = 20_000
MOST_BUCKET_BITS = 20
_WORD = r"[^ \t-\r]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source: ``share`` of all words by weight, at most ``most`` times a
    source's own; what is above is shared again by weight among the rest until none is above.
    """
    left, total = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for at, i in enumerate(order):  # those that are full at the lowest share of their weight come first
        if left * weights[i] / total <= most * sizes[i]:
            for k in order[at:]:
                out[k] = left * weights[k] / total
            break
        out[i] = float(most * sizes[i])
        left, total = left - out[i], total - weights[i]
    return out


def _scramble(n: int, key: int):
    """A permutation of range(n) as a function: a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    rng = np.random.default_rng(key)
    keys = [int(k) | 1 for k in rng.integers(1, 1 << 62, size=4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & np.uint64(mask)
        for k in keys:
            f = (right + np.uint64(k & 0xFFFFFFFF)) * np.uint64(k)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(31)) & np.uint64(mask))
        return (left << np.uint64(half)) | right

    def permuted(x: np.ndarray) -> np.ndarray:
        out = once(np.asarray(x, dtype=np.uint64))
        while (far := out >= n).any():
            out[far] = once(out[far])
        return out.astype(np.int64)

    return permuted


class Tree:
    """Draws of each source dealt to ``shards``, node by node where they are asked for.

    A shard holds a run of each source's draws, the shards one behind the other. The deals of a bounded number of
    nodes are kept; others are drawn again, with the same result.
    """

    def __init__(self, draws: np.ndarray, shards: int, seed: int):
        self.draws, self.shards, self.seed = np.asarray(draws, dtype=np.int64), shards, seed
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kept": {}}

    def left(self, low: int, high: int, held: np.ndarray) -> np.ndarray:
        """What the first half of the shards ``low`` to ``high`` gets of the ``held`` draws."""
        found = self._kept.get((low, high))
        if found is None:
            size = int(held.sum()) * ((low + high) // 2 - low) // (high - low)
            found = _deal(held, size, np.random.default_rng([self.seed, low, high]))
            if (len(self._kept) + 1) * len(held) > TABLES_HELD:
                self._kept.clear()
            self._kept[low, high] = found
        return found

    def quotas(self, first: int = 0, end: int | None = None) -> Iterator[np.ndarray]:
        """The quota of each source in the shards from ``first`` to before ``end``."""
        todo = [(0, self.shards, self.draws)]
        while todo:
            low, high, held = todo.pop()
            if high <= first or (end is not None and low >= end):
                continue
            if high - low == 1:
                yield held
                continue
            middle, left = (low + high) // 2, self.left(low, high, held)
            todo += [(middle, high, held - left), (low, middle, left)]

    def shards_of(self, source: int, draws: np.ndarray) -> np.ndarray:
        """The shards that hold the ``draws`` of one source."""
        order = np.argsort(draws, kind="stable")
        own, out = draws[order], np.empty(len(draws), dtype=np.int64)
        todo = [(0, self.shards, self.draws, 0, 0, len(own))]
        while todo:
            low, high, held, before, a, z = todo.pop()
            if a == z:
                continue
            if high - low == 1:
                out[order[a:z]] = low
                continue
            middle, left = (low + high) // 2, self.left(low, high, held)
            border = before + int(left[source])
            cut = a + int(np.searchsorted(own[a:z], border))
            todo += [(low, middle, left, before, a, cut), (middle, high, held - left, border, cut, z)]
        return out


def split_quotas(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """The quotas of all shards: ``shards`` rows that sum to ``draws``."""
    return np.array(list(Tree(draws, shards, int(rng.integers(1 << 62))).quotas()))


def _deal(held: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """One multivariate hypergeometric sample of ``size`` from the colours ``held``."""
    if held.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(held, size, method="marginals")
    left = np.zeros_like(held)
    rest = int(held.sum())
    for i, n in enumerate(held.tolist()):
        rest -= n
        left[i] = hypergeometric(n, rest, size, rng)
        size -= int(left[i])
    return left


def hypergeometric(good: int, bad: int, size: int, rng: np.random.Generator) -> int:
    """How many of ``size`` draws without replacement are among the ``good``, for populations of any size.

    Beyond the library's range the distribution is built outward from its mode, each probability from its
    neighbour's, as far as 12 standard deviations (what lies beyond has a probability under 1e-30), and
    inverted at one uniform draw.
    """
    low, high = max(0, size - bad), min(good, size)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, size))
    total = good + bad
    mode = min(max((size + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(size * (good / total) * (bad / total) * ((total - size) / (total - 1)))
    low, high = max(low, mode - int(12 * spread) - 16), min(high, mode + int(12 * spread) + 16)
    k = np.arange(mode, high, dtype=float)
    above = np.cumprod((good - k) * (size - k) / ((k + 1) * (bad - size + k + 1)))
    k = np.arange(mode, low, -1, dtype=float)
    below = np.cumprod(k * (bad - size + k) / ((good - k + 1) * (size - k + 1)))
    sums = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


TABLE_BLOCKS = 1 << 16
TABLES_HELD = 1 << 22
_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _ranks(blocks: int, key: int, own: np.ndarray | int) -> np.ndarray:
    """Places of ``own`` blocks in the permutation of all; a short permutation is kept as a table, of which
    a worker holds a bounded number."""
    if blocks > TABLE_BLOCKS:
        return _scramble(blocks, key)(np.atleast_1d(own))
    table = _TABLES.get((blocks, key))
    if table is None:
        if sum(map(len, _TABLES.values())) > TABLES_HELD:
            _TABLES.clear()
        table = _TABLES[blocks, key] = _scramble(blocks, key)(np.arange(blocks))
    return table[own] if isinstance(own, np.ndarray) else table[own : own + 1]


@dataclass
class Source:
    """A source's line of words and the draws that the mix takes from it."""

    size: int
    target: float
    key: int
    block: int = 1
    passes: int = 0
    whole: int = 0
    part: int = 0
    tree: Tree | None = None
    place: int = 0  # among the tree's sources

    def __post_init__(self) -> None:
        words = round(self.target)
        self.block = max(1, min(BLOCK_WORDS, -(-self.size // BLOCKS_PER_SOURCE)))
        self.passes, rest = divmod(words, self.size) if self.size else (0, 0)
        if rest:
            # Words of the first x permuted blocks: x * block, less what the short last block lacks.
            last = int(_scramble(self.blocks, self.key + self.passes)(_inverse_probe(self.blocks))[0])
            short = self.blocks * self.block - self.size
            self.whole = rest // self.block
            if last < self.whole or (last == self.whole and rest - self.whole * self.block >= self.block - short):
                self.whole = min((rest + short) // self.block, self.blocks)
            taken = self.whole * self.block - (short if last < self.whole else 0)
            self.part = rest - taken

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block) if self.size else 0

    @property
    def draws(self) -> int:
        return self.passes * self.blocks + self.whole + bool(self.part)

    def pieces(self, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(pass, shard, from, to) of the words [start, end) of the line that the mix takes."""
        if start >= end:
            return
        if start // self.block == (end - 1) // self.block:
            yield from self._within_block(start // self.block, start, end)
            return
        own = np.arange(start // self.block, -(-end // self.block), dtype=np.int64)
        low, high = np.maximum(own * self.block, start), np.minimum((own + 1) * self.block, end)
        for turn in range(self.passes + bool(self.whole or self.part)):
            rank = _ranks(self.blocks, self.key + turn, own)
            top = high
            if turn == self.passes:
                keep = rank < self.whole + bool(self.part)
                top = np.where(rank == self.whole, np.minimum(high, own * self.block + self.part), high)
                keep &= low < top
            else:
                keep = np.ones(len(own), dtype=bool)
            shard = self._shards(turn * self.blocks + rank[keep])
            held = None
            for s, a, b in zip(shard.tolist(), low[keep].tolist(), top[keep].tolist(), strict=True):
                if held and held[1] == s and held[3] == a:
                    held = (turn, s, held[2], b)
                else:
                    if held:
                        yield held
                    held = (turn, s, a, b)
            if held:
                yield held


    def _within_block(self, block: int, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """``pieces`` of words that lie in one block, without arrays."""
        for turn in range(self.passes + bool(self.whole or self.part)):
            rank = int(_ranks(self.blocks, self.key + turn, block)[0])
            top = end
            if turn == self.passes and rank >= self.whole:
                top = min(end, block * self.block + self.part) if rank == self.whole else start
            if start < top:
                yield turn, int(self._shards(np.array([turn * self.blocks + rank]))[0]), start, top

    def _shards(self, draws: np.ndarray) -> np.ndarray:
        return np.zeros(len(draws), dtype=np.int64) if self.tree is None else self.tree.shards_of(self.place, draws)


def _inverse_probe(blocks: int) -> np.ndarray:
    """The last block of a line, the one that may be short."""
    return np.array([blocks - 1], dtype=np.int64)


def plan(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shard_words: int = SHARD_WORDS) -> dict[str | None, Source]:
    """The draws of every source and the shards that they go to. Sources go by code point, null last."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([n for _, n in ordered], [weights[i % len(weights)] for i in range(len(ordered))], share, most)
    sources = [Source(n, t, seed + 97 * i) for i, ((_, n), t) in enumerate(zip(ordered, wanted, strict=True))]
    tree = Tree(np.array([s.draws for s in sources], dtype=np.int64), max(1, -(-round(sum(wanted)) // shard_words)), seed)
    for i, source in enumerate(sources):
        source.tree, source.place = tree, i
    return {name: source for (name, _), source in zip(ordered, sources, strict=True)}


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, size, mark``: words of every row, null texts none, and a hash of its text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.count_substring_regex(batch.column(2), _WORD), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, batch.column(3)], names=["id", "source", "size", "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return slim.mapInArrow(run, f"id {kind}, source string, size long, mark long")


def _placed(rows: DataFrame, names: dict[str, str], n_rows: int, sized: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """``rows`` with ``__cw_start``, each row's first word on its source's line, and the sources' sizes.

    ``names`` says which columns hold id, source, size and the text's hash; ``sized`` has those alone, if it is cheaper
    to read. The order on a line is that of a hash of id and size, then that of the text's hash. Rows are dealt by source and bucket
    of that hash; only the buckets' totals, a row for each source and bucket, are summed along a line.
    There are enough buckets for ``BUCKET_ROWS`` rows in each; their number does not change the order.
    """
    bits = min(MOST_BUCKET_BITS, max(8, (n_rows // BUCKET_ROWS).bit_length()))
    key, source, size, mark = (F.col(names[k]) for k in ("id", "source", "size", "mark"))

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("__cw_h", F.xxhash64(key, size)).withColumn("__cw_bucket", F.shiftrightunsigned("__cw_h", 64 - bits))

    totals = bucketed(rows if sized is None else sized).groupBy(source.alias("__cw_o_source"), F.col("__cw_bucket").alias("__cw_o_bucket")).agg(F.sum(size).alias("__cw_o_words"))
    along = Window.partitionBy("__cw_o_source").orderBy("__cw_o_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.withColumn("__cw_o_offset", F.coalesce(F.sum("__cw_o_words").over(along), F.lit(0))), "offsets")
    sizes = [(r["__cw_o_source"], r["words"]) for r in offsets.groupBy("__cw_o_source").agg(F.sum("__cw_o_words").alias("words")).collect()]
    inner = Window.partitionBy(source, "__cw_bucket").orderBy("__cw_h", key, size, mark).rowsBetween(Window.unboundedPreceding, -1)
    own = bucketed(rows).withColumn("__cw_before", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    placed = own.join(offsets, source.eqNullSafe(F.col("__cw_o_source")) & (F.col("__cw_bucket") == F.col("__cw_o_bucket")))
    placed = placed.withColumn("__cw_start", F.col("__cw_o_offset") + F.col("__cw_before"))
    return placed.drop("__cw_h", "__cw_bucket", "__cw_before", "__cw_o_source", "__cw_o_bucket", "__cw_o_words", "__cw_o_offset"), sizes


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, size, source_size, target, taken, n_pieces, shards``.

    ``shards`` says which output shards take how many of the row's words, as ``shard:words`` joined by commas,
    by shard; empty if none are taken. Null texts have size 0; a null source is a source of its own, the
    last; sources that are not strings count as strings. Texts may be of any length. Repeated rows and null
    ids are rows like any other. The same rows give the same result in any order. Other columns are not
    read. ``settings`` go to ``plan``.
    """
    sized = written(_sized(docs, id_col, text_col, source_col), "sizes")
    placed, sizes = _placed(sized, {k: k for k in ("id", "source", "size", "mark")}, sized.count())
    made = plan(sizes, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, targets_, taken, pieces, shards = [], [], [], [], []
            for name, start, size in zip(*(batch.column(k).to_pylist() for k in (1, 3, 2)), strict=True):
                source = made[name]
                got = list(source.pieces(start, start + size))
                own.append(source.size)
                targets_.append(source.target)
                taken.append(sum(b - a for _, _, a, b in got))
                pieces.append(len(got))
                words: Counter[int] = Counter()
                for _, shard, a, b in got:
                    words[shard] += b - a
                shards.append(",".join(f"{shard}:{n}" for shard, n in sorted(words.items())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(own, pa.int64()), pa.array(targets_, pa.float64()), pa.array(taken, pa.int64()), pa.array(pieces, pa.int64()), pa.array(shards, pa.string())],
                names=["id", "size", "source_size", "target", "taken", "n_pieces", "shards"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = placed.select("id", "source", "size", "__cw_start").mapInArrow(run, f"id {kind}, size long, source_size long, target double, taken long, n_pieces long, shards string")
    return out.withColumnRenamed("id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", shard_col: str = "mix_shard", order_col: str = "mix_order", **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, then ``shard_col`` (int) and ``order_col`` (long).

    A row for every piece of a document that the mix takes in a pass over its source: the whole text
    if all its words are taken together, else the text from the piece's first word to its last;
    ``length_col``, if there, is the piece's length. A document never takes more than ``most`` passes.
    Rows without words are never taken. Shards are read in the order of ``order_col``, which is
    shuffled within each shard; ``write_shards`` stores them so. Nulls as in ``mix_sizes``.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    named = docs.withColumn("__cw_source", F.col(source_col).cast("string")).withColumn("__cw_mark", F.xxhash64(text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.count_substring_regex(batch.column(names.index(text_col)), _WORD), 0).cast(pa.int64())
            yield batch.append_column("__cw_size", size)

    schema = T.StructType([*named.schema.fields, T.StructField("__cw_size", T.LongType())])
    light = _sized(docs, id_col, text_col, source_col).toDF(id_col, "__cw_source", "__cw_size", "__cw_mark")
    placed, sizes = _placed(named.mapInArrow(count, schema), {"id": id_col, "source": "__cw_source", "size": "__cw_size", "mark": "__cw_mark"}, docs.count(), light)
    made = plan(sizes, **settings)
    out_schema = T.StructType([*docs.schema.fields, T.StructField(shard_col, T.IntegerType()), T.StructField(order_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, shards, order = [], [], [], []
            rows = zip(*(batch.column(k).to_pylist() for k in (len(names), names.index(text_col), len(names) + 1, len(names) + 2)), strict=True)
            for k, (name, text, size, start) in enumerate(rows):
                spans = None
                for turn, shard, a, b in made[name].pieces(start, start + size):
                    if b - a == size:
                        piece = text
                    else:
                        spans = [m.span() for m in re.finditer(_WORD, text)] if spans is None else spans
                        piece = text[spans[a - start][0] : spans[b - start - 1][1]]
                    at.append(k)
                    texts.append(piece)
                    shards.append(shard)
                    order.append(xxhash.xxh64_intdigest(f"{name}:{turn}:{a}", SEED) >> 1)
            part = batch.select(names).take(pa.array(at, pa.int64()))
            columns = list(part.columns)
            columns[names.index(text_col)] = pa.array(texts, columns[names.index(text_col)].type)
            if length_col in names:
                columns[names.index(length_col)] = pa.array(map(len, texts), columns[names.index(length_col)].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shards, pa.int32()), pa.array(order, pa.int64())], names=[*names, shard_col, order_col])

    return placed.select(*names, "__cw_source", "__cw_size", "__cw_start").mapInArrow(run, out_schema)


def in_shards(mixed: DataFrame, shard_col: str = "mix_shard", order_col: str = "mix_order") -> DataFrame:
    """``mix``'s rows with every shard whole in one partition, in the shuffled order of the shard. A shard has
    about ``SHARD_WORDS`` words, so a partition is no larger for a larger input."""
    return mixed.repartition(shard_col).sortWithinPartitions(shard_col, order_col)


def write_shards(mixed: DataFrame, path: str) -> None:
    """``mix``'s rows as one folder for each shard under ``path``, in the shuffled order of the shard."""
    in_shards(mixed).write.partitionBy("mix_shard").parquet(path)
