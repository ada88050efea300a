"""SimHash near-duplicates by a range join over per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import materialise, ship_package
from lumenforge.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of one text over its 3-word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    k = min(n, SHINGLE)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # 2 MB of bits at a time
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        prints = np.array([fingerprint(x) for x in b["x"]], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"id": b["id"], "fp": prints})


def segment_counts(half):
    """Bit counts of the sixteen 2-bit segments of the low 32 bits, each in its own 2-bit field."""
    low = half.bitwiseAND(F.lit(0x55555555))
    return low + F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def grid_cell(half):
    """Segment counts of a half cut into 2-bit segments and, shifted by one bit around the ring, into the pairs between them.

    One differing bit is one step in one segment of each cut, so the Manhattan distance over both is twice a lower bound of the
    differing bits. Counts of neighbouring pairs leave two halves at most in a cell.
    """
    turned = F.shiftright(half, 1) + F.shiftleft(half.bitwiseAND(F.lit(1)), 31)
    return segment_counts(half) + F.shiftleft(segment_counts(turned), 32)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints that differ in at most ``distance`` (3 or less) bits.

    Of two such prints, one 32-bit half differs in at most one bit. Each half is embedded as per-segment bit counts of two
    overlapping cuts; the Manhattan distance of two embeddings bounds the differing bits, so a half within one bit lies in the same
    cell of that grid or one bit's step away. One side probes its own cell and the cells one step up (a bit that it lacks), the other
    its own cell; the exact distance then decides inside the join, so only links leave it. A pair that meets in both halves is emitted once.
    Cells hold two values of a half at most, so chance meetings stay few at any size; what many prints share in one half, the skew join splits.
    """
    if distance > 3:
        raise ValueError("the half-wise bound holds for at most 3 differing bits")
    fp = F.col("fp")
    own = prints.select("fp", F.posexplode(F.array(fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))).alias("half", "value"))
    right = own.select(F.col("fp").alias("q"), F.col("half").alias("qh"), grid_cell(F.col("value")).alias("qc"))
    steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    left = own.select("fp", "half", "value", F.explode(steps).alias("step")).where((F.col("value").bitwiseAND(F.col("step"))) == 0)
    left = left.select("fp", "half", "step", grid_cell(F.col("value") + F.col("step")).alias("cell"))
    differ = F.col("fp").bitwiseXOR(F.col("q"))
    near = (F.bit_count(differ) <= distance) & ((F.col("step") != 0) | (F.col("fp") < F.col("q")))
    # a half reports pairs that differ in at most one of its bits; where both do, the low half reports the pair
    low, high = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned(differ, 32))
    once = F.when(F.col("half") == 0, low <= 1).otherwise((high <= 1) & (low > 1))
    pairs = left.join(right, (left.half == right.qh) & (left.cell == right.qc) & near & once)
    return pairs.select(F.least("fp", "q").alias("a"), F.greatest("fp", "q").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Fingerprint of every document and the smallest id it reaches through links of at most ``distance`` bits.

    Text: A-Z lower-cased, words split at ASCII white space, 3-word shingles with repeats,
    XXH64 with seed 42; a bit is 1 if set in over half of the shingles. Equal prints are one class, joined
    to others once however many copies there are. Null and empty text have print zero and link like any
    other; repeated ids are each returned; a null id never becomes a component's id unless alone.
    Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
    prints = materialise(rows.mapInPandas(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long"), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    pairs = materialise(links(classes.select("fp"), distance), "simhash-links")
    comp = connected_components(pairs)
    classes = classes.join(comp, classes.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
