"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregate; the driver sees only two numbers per round. The number of
rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``u`` to the smaller ``v``."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)``, longs, any direction, no loops -> ``(node, root)``: the smallest node that
    each node reaches. Nodes without edges do not appear. Null ends are ignored; no edges, no rows.
    Raises if ``rounds`` are not enough, which takes a path of astronomical length.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        state = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = written(_small_star(_large_star(now)), "stars")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
