"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is read as tokens: runs of characters that are not white space, cut every 12 characters; in scripts that
are written without spaces every character is a token, so one character more does not shift the others. A k-mer is K tokens in a row, its inner substrings are
the S tokens in a row within it. A k-mer is a closed syncmer if the inner substring of least hash
stands at its left or right edge. Whether it does depends on the k-mer alone, so the same passage
gives the same anchors in any surroundings, and their positions match it across documents.

The fingerprint is the SKETCH least hashes of the distinct syncmers of the whole text; the likeness
of two fingerprints estimates the share of common syncmers among all of both (Jaccard).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
S = 2
SKETCH = 128
# Fixed value: blocks of scripts without spaces: Thai and Lao, Myanmar, Khmer, from the CJK radicals to the ideographs.
SPACELESS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
TOKEN = rf"[^\s{SPACELESS}]{{1,12}}|[{SPACELESS}]"
BUCKET_ROWS = 512
MOST_BUCKETS = 1 << 16


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _inner(tokens: str) -> Column:
    """Hash of the S tokens from each place on."""
    spots = F.when(F.size(tokens) >= S, F.sequence(F.lit(1), F.size(tokens) - (S - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.xxhash64(*(F.get(F.col(tokens), i + (j - 1)) for j in range(S))))


def _chosen(inner: str) -> Column:
    """Places, from 0, of the k-mers whose least inner hash is at an edge."""
    width = K - S + 1
    count = F.size(inner) - (width - 1)
    spots = F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def closed(i: Column) -> Column:
        hashes = [F.get(F.col(inner), i + j) for j in range(width)]
        return F.least(hashes[0], hashes[-1]) <= F.least(*hashes[1:-1])

    return F.filter(spots, closed)


def _kmer(inner: str, i: Column) -> Column:
    """Hash of the k-mer at place i, from inner hashes that cover its tokens."""
    places = [*range(0, K - S, S), K - S]
    return F.xxhash64(*(F.get(F.col(inner), i + j) for j in places))


def _short(hashed: Column) -> Column:
    """31 bits of a hash."""
    return hashed.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def with_anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out array<struct<place int, hash long>>``: every closed syncmer of the whole text.

    A text of fewer than K tokens has one anchor, all of it; one without tokens, or null, has none.
    """
    t, h = f"__cw_{out}_t", f"__cw_{out}_h"
    few = F.size(t) < K
    own = F.when(F.size(t) == 0, F.array()).when(few, F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(t).alias("hash"))))
    all_ = F.transform(_chosen(h), lambda i: F.struct(i.alias("place"), _kmer(h, i).alias("hash")))
    return df.withColumn(t, _tokens(F.col(text_col))).withColumn(h, _inner(t)).withColumn(out, own.otherwise(all_)).drop(t, h)


def with_sketch(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out array<int>``: the least SKETCH 31-bit hashes of the text's anchors, ascending."""
    t, h, a = (f"__cw_{out}_{x}" for x in "tha")
    few = F.when(F.size(t) == 0, F.array().cast("array<int>")).when(F.size(t) < K, F.array(_short(F.xxhash64(t))))
    all_ = F.transform(_chosen(h), lambda i: _short(_kmer(h, i)))
    return (
        df.withColumn(t, _tokens(F.col(text_col)))
        .withColumn(h, _inner(t))
        .withColumn(a, few.otherwise(all_))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct(a)), 1, SKETCH))
        .drop(t, h, a)
    )


def likeness(left: str, right: str) -> Column:
    """Share of the least SKETCH hashes of both that both have; 1 for two empty sketches."""
    both = F.slice(F.sort_array(F.array_union(left, right)), 1, SKETCH)
    common = F.array_intersect(F.array_intersect(both, F.col(left)), F.col(right))
    return F.when(F.col(left) == F.col(right), F.lit(1.0)).otherwise(F.size(common) / F.size(both))


def spelled(sketch: str) -> Column:
    """A sketch as a string: eight lowercase hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _bucketed(df: DataFrame, bounds: list[int]) -> DataFrame:
    """``df`` with ``__cw_b``: how many ``bounds`` its ``__cw_key`` has reached. Every 256th bound is looked through first, then the
    256 from there on; the bounds are one array of numbers, whose value is bound once for each row."""
    step = 256
    key = F.col("__cw_key")
    lists = [sorted(bounds)[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    held = F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")
    coarse = F.size(F.filter(held, lambda x: F.get(x, F.lit(0)) <= key))
    row = F.greatest(coarse - 1, F.lit(0))
    return df.withColumn("__cw_row", row).withColumn("__cw_b", F.col("__cw_row") * step + F.size(F.filter(F.get(held, F.col("__cw_row")), lambda x: x <= key))).drop("__cw_row")


def with_next(docs: DataFrame, id_col: str, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``carried``: the next row's, by descending ``id_col``,
    after the last row the first's. Null ids come last; equal ids go by a hash of ``carried[0]``.

    Rows are dealt into ranges of ids of about equal number. A range's first row is also dealt, as a
    copy, to the end of the range before it, so no range waits for another.
    """
    keyed = docs.withColumn("__cw_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("__cw_tie", F.xxhash64(carried[0]))
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // bucket_rows))
    bounds: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(keyed.agg(F.percentile_approx("__cw_key", shares, 20 * buckets)).first()[0]))
    dealt = _bucketed(keyed, bounds)
    # A row for each range, MOST_BUCKETS + 1 at most: its first row and the range that its copy goes to.
    order = F.struct(F.col("__cw_key").alias("k"), F.bitwise_not("__cw_tie").alias("t"))
    tops = sorted(dealt.groupBy("__cw_b").agg(F.max(order).alias("top")).collect())
    firsts = [(r["__cw_b"], r["top"]["k"], ~r["top"]["t"], tops[(i + 1) % len(tops)]["__cw_b"]) for i, r in enumerate(tops)]
    first = docs.sparkSession.createDataFrame(firsts, "__cw_fb int, __cw_fk long, __cw_ft long, __cw_to int")
    joined = dealt.join(F.broadcast(first), F.col("__cw_b") == F.col("__cw_fb"))
    is_first = (F.col("__cw_key") == F.col("__cw_fk")) & (F.col("__cw_tie") == F.col("__cw_ft"))
    homes = F.when(is_first, F.array(F.struct(F.col("__cw_b").alias("b"), F.lit(0).alias("g")), F.struct(F.col("__cw_to").alias("b"), F.lit(1).alias("g"))))
    homes = homes.otherwise(F.array(F.struct(F.col("__cw_b").alias("b"), F.lit(0).alias("g"))))
    spread = joined.select(*docs.columns, "__cw_key", "__cw_tie", F.explode(homes).alias("__cw_home"))
    spread = spread.withColumn("__cw_b", F.col("__cw_home.b")).withColumn("__cw_g", F.col("__cw_home.g"))
    w = Window.partitionBy("__cw_b").orderBy("__cw_g", F.desc("__cw_key"), "__cw_tie")
    return spread.select(*docs.columns, "__cw_g", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where("__cw_g = 0").drop("__cw_g")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of its code points replaced by
    the first as many of the next document by descending id, after the last document by the first's.

    One row for each row of ``docs``, repeated rows included: ``id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``. Null texts count as empty: an empty
    fingerprint, like another empty one with 1.0 and any other with 0.0. Null ids come last in the
    order; rows of one id go by a hash of the text. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_sketch(slim, "text", "sketch").select("text", "id", "sketch")
    both = with_next(own, "id", ["text", "sketch"])
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", (F.col("n_chars") / 3).cast("int"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("cut"))))
    both = with_sketch(both.select("id", "n_chars", "edited", "sketch", "next_sketch"), "edited", "edited_sketch")
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled("sketch").alias("fingerprint"),
        spelled("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
