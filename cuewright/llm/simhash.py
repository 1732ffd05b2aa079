"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
two bits have a segment in which they differ in at most one, so that segment's one-wildcard
variants (the segment with bit i ignored, for each i) hold an equal pair. Each distinct fingerprint
is indexed under its 64 variants, equal variants are joined, and pairs are verified bit by bit.

A variant that more than ``dense`` distinct fingerprints share is not paired, which would be
quadratic. Its fingerprints are linked exactly another way: two fingerprints are within two bits
if and only if some 64-bit value is within one bit of both, so they meet in one of the 65 values
around each; at most 65 fingerprints can meet in a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches, written
from cuewright.llm.components import components
from cuewright.llm.near_copies import near_copies

SEED = 42
WIDTH = 3
MAX_BITS = 2
DENSE = 48
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit number; 0 for null and wordless texts.

    A-Z are lowered, words are the runs between ASCII white space, shingles are ``width`` words
    joined by a space, repeats included; a shorter text is one shingle.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = iter((b" ".join(words),))
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        some = hashes[at : at + 65536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _keys(id_col: str, text_col: str) -> list:
    """Two hashes that tell rows apart by id and text; repeated rows share them."""
    return [F.xxhash64(id_col, text_col).alias("ka"), F.hash(text_col, id_col).alias("kb")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ka, kb, fp long)`` for every row, repeated rows and null ids included; ka and kb
    are hashes of id and text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], names=["id", "ka", "kb", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, ka long, kb int, fp long").withColumnRenamed("id", id_col)


def _variants(fps: DataFrame) -> DataFrame:
    """``(k, fp)``: 2 segments times 32 ignored bits; k packs the place and the remaining bits."""
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
    return spread.select(
        F.expr(
            "(shiftright(fp, 32 * (w div 32)) & 4294967295L & ~shiftleft(1L, w % 32)) | shiftleft(cast(w as long), 32)"
        ).alias("k"),
        "fp",
    )


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """``(u, v)``, u < v: enough of the pairs within two bits among the distinct ``fps(fp)`` to give
    the same components as all of them. Below ``dense`` sharers of a variant every pair is there.
    """
    shared = written(
        _variants(fps).groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"),
        "shared",
    )
    close = F.expr(f"bit_count(u ^ v) <= {MAX_BITS}")
    two = shared.where("n = 2").select("u", "v").where(close)
    # Both joins deal the variants out by k once more, whatever the size of the other side, and share that exchange.
    few = _variants(fps).join(shared.where(f"n > 2 and n <= {dense}").select("k").hint("merge"), "k")
    some = (
        few.select("k", F.col("fp").alias("u")).join(few.select("k", F.col("fp").alias("v")), "k").where("u < v").select("u", "v").where(close)
    )
    many = _variants(fps).join(shared.where(f"n > {dense}").select("k").hint("merge"), "k").select("fp").distinct()
    around = many.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("b")).select(
        F.expr("if(b < 0, fp, fp ^ shiftleft(1L, b))").alias("p"), "fp"
    )
    met = around.groupBy("p").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")  # 65 at most
    hubs = met.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u < v")
    return two.unionAll(some).unionAll(hubs).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, dense: int) -> tuple[DataFrame, DataFrame]:
    """``fingerprints`` of the rows, and for each fingerprint its component: ``(fp, root)``."""
    each = written(fingerprints(docs, id_col, text_col), "fingerprints")
    # A row of a few bytes becomes 64 when it is read, so the rows are dealt out to many files.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = written(each.select("fp").distinct().repartition(tasks), "distinct")
    roots = components(links(fps, dense))
    return each, fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at two or fewer differing bits; a component's id is its smallest ``id_col``.
    Null texts count as empty, and texts without words have fingerprint zero and link like any
    other. Rows with a null id are returned with their component's id and never name one; a
    component of such rows only has a null id. Repeated rows stay. Texts of any length count whole. Other
    columns are not read.
    """
    each, rooted = _grouped(docs, id_col, text_col, dense)
    first = each.groupBy("fp").agg(F.min(id_col).alias("first_id")).join(rooted, "fp")
    named = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return each.join(by_fp, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies (five-word shingles, Jaccard 0.8 or more),
    the one of the smallest id, all columns as they are. The fingerprints are wider than those of ``near_duplicates``: at
    this similarity 64 bits differ in up to 14, which no index of their variants reaches.

    Null ids come after all others; of rows with one id the smallest hash of id and text stays, and of
    repeated rows one. Null texts count as empty in comparing and stay null.
    """
    each, rooted = near_copies(docs, id_col, text_col, _keys(id_col, text_col))
    place = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), "ka", "kb")
    first = each.groupBy("node").agg(F.min(place).alias("p")).join(rooted, "node")
    kept = first.groupBy("root").agg(F.min("p").alias("p")).select(F.col("p.ka").alias("__cw_ka"), F.col("p.kb").alias("__cw_kb"))
    ka, kb = _keys(id_col, text_col)
    keyed = docs.withColumns({"__cw_ka": ka, "__cw_kb": kb})
    found = keyed.join(kept.hint("merge"), ["__cw_ka", "__cw_kb"], "left_semi")
    return found.dropDuplicates(["__cw_ka", "__cw_kb"]).select(*docs.columns)
