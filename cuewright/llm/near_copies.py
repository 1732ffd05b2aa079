"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by SimHash.

A set's fingerprint is a SimHash of 40 words of 64 bits. Two sets at the least similarity differ in 15 % of the bits, which no
single segment bears, so the fingerprint is cut into 80 segments of 32 bits, and each is indexed under its four
deletion variants: the segment without one of its bytes. Sets that share a variant are candidates. A pair
at the least similarity shares one with probability 1 - 0.938**80 = 0.994, at 0.85 with 0.9999. Candidates are those of
which the fingerprints are within ``MOST_BITS``, six standard deviations above the expected distance; every one is
verified on the sets themselves.

The members of a variant with at most ``DENSE`` sets are compared in pairs. Sets that meet in larger ones are compared with one
another not by variant, which would be quadratic, but by their rare shingles: ordered from the rarest among them on, two similar sets have
their first common shingle so early in both that what is left suffices for the similarity. So each set has its first fifth
stand for it, and no similar pair of these sets is lost. Under each shingle the sets first meet a hub: the one that has the fewest shingles of its own, then the
same among those outside the hub's component, ``ROUNDS`` times. What is then outside the first hub's component meets all of other
components. No variant and no shingle is cut short. Texts are read once more for all that is to be verified, as sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches, written
from cuewright.llm.components import components

SEED = 42
WIDTH = 5
SIMILAR = (4, 5)  # as a fraction, so that the limit itself is met exactly
WORDS = 40
MOST_BITS = 512  # of all
MOST_IN_WORD = 24  # of the first word, which goes along with the variants: five standard deviations
DENSE = 16
ROUNDS = 3
CHUNK = 255  # counters of a byte hold so many
PAIRS_PER_BATCH = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_DRAW = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, WORDS), dtype=np.uint64)
_TIMES, _PLUS = _DRAW[0] | np.uint64(1), _DRAW[1]
_LOWEST = np.uint64(0x0101010101010101)  # of each byte


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of one UTF-8 text, rising; words and short texts as in SimHash."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = (b" ".join(words),) if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64))


def fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of one set of shingles, as signed 64-bit numbers: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros((WORDS, 64), dtype=np.int64)
    for at in range(0, len(found), CHUNK):
        x = found[at : at + CHUNK, None] * _TIMES + _PLUS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        for bit in range(8):
            counts = ((x >> np.uint64(bit)) & _LOWEST).sum(axis=0, dtype="<u8")
            ones[:, bit::8] += counts.view(np.uint8).reshape(WORDS, 8)
    return np.packbits(2 * ones > len(found), axis=1, bitorder="little").view("<i8").ravel().tolist()


def _variants(nodes: DataFrame) -> DataFrame:
    """``(k, node)``: 2 segments of each word times 4 left-out bytes; k packs the place and the remaining bits."""
    words = nodes.select("node", F.posexplode("fp").alias("w", "x")).select("node", "w", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("d"))
    return words.select(F.expr("(shiftright(x, 32 * (d div 4)) & 4294967295L & ~shiftleft(255L, 8 * (d % 4))) | shiftleft(cast(8 * w + d as long), 32)").alias("k"), "node")


def _close(a: str, b: str) -> Column:
    """Whether two fingerprints are within ``MOST_BITS``."""
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(WORDS)) + f" <= {MOST_BITS}")


def _possible(a_n: str, a: str, b_n: str, b: str) -> Column:
    """What sizes and first words tell: sizes that differ more cannot be similar."""
    return F.expr(f"{SIMILAR[1]}L * least({a_n}, {b_n}) >= {SIMILAR[0]}L * greatest({a_n}, {b_n}) and bit_count({a} ^ {b}) <= {MOST_IN_WORD}")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _marked(docs: DataFrame, id_col: str, text_col: str, keys: list) -> DataFrame:
    """``(id, ka, kb, node, n, fp)`` for every row: ``node`` stands for the set of shingles, 0 for the empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(3).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            columns = [pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "ka", "kb", "node", "n", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), *keys, F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, ka long, kb int, node long, n int, fp array<long>").withColumnRenamed("id", id_col)


def _sets(bodies: DataFrame) -> DataFrame:
    """``(node, n, found)`` of ``bodies(node, text)``: the hashes of the shingles, rising."""
    small_batches(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "n", "found"])

    return bodies.mapInArrow(run, "node long, n int, found array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` that reach the similarity; ``sets(node, found)``."""
    small_batches(pairs.sparkSession, PAIRS_PER_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("found").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("found").alias("b"))
    joined = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "a", "b")
    found = written(joined.mapInArrow(run, "u long, v long"), "verified")
    small_batches(pairs.sparkSession)
    return found


def _enough(n: str, i: str, x_n: str, x_i: str) -> Column:
    """Whether sets of sizes ``n`` and ``x_n`` can be similar if the first shingle that they share is the ``i``-th of one and the
    ``x_i``-th of the other, counted from 0."""
    a, b = SIMILAR
    return F.expr(f"{a + b}L * least({n} - {i}, {x_n} - {x_i}) >= {a}L * ({n} + {x_n})")


def _rare(sets: DataFrame) -> DataFrame:
    """``(t, node, n, i, s)``: the shingles ``t`` of each set that can be its first one in common with a similar set, rarest first, with
    their places ``i``, and in how many sets its rarest is."""
    a, b = SIMILAR
    own = Window.partitionBy("node")
    each = sets.select("node", "n", F.explode("found").alias("t")).withColumn("f", F.count("*").over(Window.partitionBy("t")))
    ranked = each.withColumn("i", F.row_number().over(own.orderBy("f", "t")) - 1).withColumn("s", F.min("f").over(own))
    first = ranked.where(f"f > 1 and {b}L * i <= {b - a}L * n")
    least = first.withColumn("least", F.min("n").over(Window.partitionBy("t")))  # or, if more, the least similar size
    useful = least.where(f"{a + b}L * {b} * (n - i) >= {a}L * ({b}L * n + greatest({b}L * least, {a}L * n))")
    return written(useful.select("t", "node", "n", "i", "s"), "rare")


def _across(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links(u, v)`` and enough of the similar pairs of ``sets`` to give the same components as all of them."""
    rare = _rare(sets)
    ordered = F.least("node", "x").alias("u"), F.greatest("node", "x").alias("v")
    different, enough = F.expr("c <> x_c"), _enough("n", "i", "x_n", "x_i")

    def by_component() -> DataFrame:
        own = written(components(links), "roots").select("node", F.col("root").alias("c"))
        return written(rare.join(own.hint("merge"), "node", "left").withColumn("c", F.coalesce("c", "node")), "placed")

    def outside(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Those of ``rows`` that are in other components than their shingle's hub."""
        hub_c = hubs.select("t", F.col("x").alias("node")).join(placed.select("t", "node", F.col("c").alias("hub_c")).hint("merge"), ["t", "node"]).drop("node")
        return written(rows.join(hub_c.hint("merge"), "t").where("c <> hub_c").drop("hub_c"), "apart")

    placed = apart = by_component()
    first = None
    for _ in range(ROUNDS):
        if apart.isEmpty():
            break
        hubs = apart.groupBy("t").agg(F.min(F.struct(-F.col("s"), "node", "n", "i", "c")).alias("h"))
        hubs = written(hubs.select("t", F.col("h.node").alias("x"), F.col("h.n").alias("x_n"), F.col("h.i").alias("x_i"), F.col("h.c").alias("x_c")), "hubs")
        first = hubs if first is None else first
        met = placed.join(hubs.hint("merge"), "t").where(different & enough).select(*ordered).distinct()
        links = written(links.unionAll(_verified(met, sets)), "links")
        placed = by_component()
        apart = outside(apart.drop("c").join(placed.select("t", "node", "c").hint("merge"), ["t", "node"]), hubs)
    if first is None:
        return links
    others = outside(placed, first)  # two that the first hub's component holds are linked
    others = others.select("t", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("i").alias("x_i"), F.col("c").alias("x_c"))
    met = placed.join(others.hint("merge"), "t").where(different & enough).select(*ordered).distinct()
    return links.unionAll(_verified(met, sets))


def near_copies(docs: DataFrame, id_col: str, text_col: str, keys: list) -> tuple[DataFrame, DataFrame]:
    """``(id_col, ka, kb, node)`` of the rows, and ``(node, root)`` of every node; ``keys`` are the two
    hashes ka and kb that tell rows apart by id and text."""
    each = written(_marked(docs, id_col, text_col, keys), "marked")
    place = F.min(F.struct("ka", "kb", "n", "fp")).alias("p")
    nodes = written(each.where("n > 0").groupBy("node").agg(place).select("node", "p.*"), "nodes")
    sharers = F.count("*").over(Window.partitionBy("k"))
    shared = written(_variants(nodes).withColumn("m", sharers).where("m > 1"), "variants")
    dense = written(shared.where(f"m > {DENSE}").select("node").distinct(), "dense")
    first_word = nodes.select("node", "n", F.col("fp")[0].alias("w")).join(dense.withColumn("z", F.lit(True)).hint("merge"), "node", "left")
    few = written(shared.where(f"m <= {DENSE}").drop("m").join(first_word.hint("merge"), "node").withColumn("z", F.coalesce("z", F.lit(False))), "members")

    other = few.select(F.col("k").alias("o_k"), F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("w").alias("x_w"), F.col("z").alias("x_z"))
    possible = F.expr("node < x and not (z and x_z)") & _possible("n", "w", "x_n", "x_w")
    met = few.join(other, (F.col("k") == F.col("o_k")) & possible).select(F.col("node").alias("u"), F.col("x").alias("v")).distinct()
    u, v = (nodes.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp")).hint("merge") for c in "uv")
    close = written(met.join(u, "u").join(v, "v").where(_close("u_fp", "v_fp")).select("u", "v"), "close")

    ends = dense.unionAll(close.select("u")).unionAll(close.select("v")).distinct()
    some = nodes.select("ka", "kb", "node").join(ends.hint("merge"), "node", "left_semi")
    texts = docs.select(*keys, F.col(text_col).cast("binary").alias("text"))
    bodies = texts.join(some.hint("merge"), ["ka", "kb"]).dropDuplicates(["ka", "kb"]).select("node", "text")
    sets = written(_sets(bodies), "sets")
    links = _across(sets.join(dense.hint("merge"), "node", "left_semi"), _verified(close, sets))
    joined = components(links)
    return each.drop("n", "fp"), each.select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
