"""Connected components by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import discard, materialise


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node it reaches.

    Each round is a large star (greater neighbours move to the smallest one) and a
    small star (a node and its smaller neighbours move to the smallest of them);
    the rounds needed grow with the logarithm of the largest component. Minima are
    combined map-side, neighbour lists are never collected, and every round is
    written to the shared folder, so lineage stays short. Self-loops, repeated and
    reversed edges and null ends change nothing; an empty table gives no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    e = materialise(e, "cc")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialise(small, "cc")
        # a forest of stars in which no centre is itself a leaf is the fixed point
        now = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(e)
        e = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
