"""Exact deduplication over an extendible-hash index kept on shared files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import ascii_lower, discard, materialise

#: Bytes that a page holds, and what a row adds to its text; pages grow only where a directory would have over 2 ** PAGES_LOG of them.
PAGE_BYTES, ROW_BYTES, PAGES_LOG = 1 << 20, 64, 20
#: Times that a pass doubles the directory, and bits of a key.
LEVEL, KEY_BITS = 12, 64


def _prefix(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a key."""
    return F.shiftrightunsigned(h, KEY_BITS - bits)


def _depths(loads: DataFrame, capacity: int, done: int, bits: int) -> DataFrame:
    """(slot, depth) of the ``2 ** bits`` finest slots below buckets of depth ``done``; ``n`` is a slot's load.

    A bucket splits on its next bit, and the directory doubles for it, while it is overfull. Overfull buckets around a slot have
    depths done, done + 1, ... without a gap, so their number says how often the slot's bucket has split.
    """
    around = loads.select("slot", "n", F.explode(F.array(*(F.lit(d) for d in range(done, bits)))).alias("depth"))
    around = around.withColumn("bucket", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    full = around.groupBy("depth", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select("depth", "bucket")
    split = around.join(full, ["depth", "bucket"], "left_semi").groupBy("slot").agg(F.count("*").alias("times"))
    return loads.join(split, "slot", "left").select("slot", "n", (F.lit(done) + F.coalesce("times", F.lit(0))).cast("int").alias("depth"))


def directory(keys: DataFrame, capacity: int, level: int = LEVEL) -> DataFrame:
    """(bits, slot, depth, bucket): the extendible directory over hash keys ``h`` with loads ``n``, each of at most ``capacity``.

    It starts from one bucket. Each pass doubles it ``level`` times; buckets that are still overfull go on in the next
    pass, which looks at their keys alone, until none is or the keys' bits are used up. ``slot`` is the first ``bits`` bits
    of the keys in it and ``bucket`` the first ``depth`` ones; every key lies in exactly one slot.
    """
    out, rest, done = None, keys, 0
    while True:
        bits = min(KEY_BITS, done + level)
        loads = materialise(rest.groupBy(_prefix(F.col("h"), bits).alias("slot")).agg(F.sum("n").alias("n")), "dedup-loads")
        depths = materialise(_depths(loads, capacity, done, bits), "dedup-directory")
        discard(loads)
        over = (F.col("depth") == bits) & (F.col("n") > capacity) & F.lit(bits < KEY_BITS)
        part = depths.where(~over).select(F.lit(bits).alias("bits"), "slot", "depth", F.expr(f"shiftrightunsigned(slot, {bits} - depth)").alias("bucket"))
        out = part if out is None else out.union(part)
        more = depths.where(over).select("slot")
        if more.isEmpty():
            return out
        rest = rest.join(more, _prefix(F.col("h"), bits) == more.slot, "left_semi")
        done = bits


def _paged(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` with depth and bucket of their key ``h``, by a join with the slots of each pass (as many as its bits allow)."""
    out = []
    for (bits,) in slots.select("bits").distinct().collect():
        part = slots.where(F.col("bits") == bits).select("slot", "depth", "bucket")
        out.append(rows.join(part, _prefix(F.col("h"), bits) == part.slot).drop("slot"))
    return reduce(DataFrame.union, out) if out else rows.where("false").select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_bytes: int = PAGE_BYTES, level: int = LEVEL, key_bits: int = KEY_BITS
) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z; the largest id of a group stays.

    Rows with their keys (64-bit hashes of the normalised texts), digests and bytes lie on shared files. The directory splits
    buckets of more than a page; a key that alone is more cannot split and is chained over as many overflow pages as it
    fills, dealt by row. Owners take whole pages, that is ranges of keys, and tell the texts under a key apart by their bytes; what overflow pages
    found is combined. A page is ``page_bytes``, or a 2 ** PAGES_LOG-th of all where that is more, so the directory
    stays small next to the rows; Spark broadcasts it where its size allows. ``key_bits`` below 64 makes keys collide.

    Returns id, keep_id, group_size, kept, text_sha256. Null text counts as empty and equals
    empty text; rows with the same id count separately in group_size and are each returned;
    null ids stay only when the whole group has none. Empty input gives no rows; other columns are ignored.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    key = F.shiftleft(_prefix(F.xxhash64("x"), key_bits), KEY_BITS - key_bits)
    leaf = docs.select(F.col(id_col).alias("id"), norm.alias("x"))
    leaf = materialise(leaf.select("id", "x", key.alias("h"), F.unhex(F.sha2("x", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "dedup-leaf")

    keys = leaf.groupBy("h").agg(F.sum(F.octet_length("x") + F.lit(ROW_BYTES)).alias("n"))
    keys = materialise(keys, "dedup-keys")
    page = max(page_bytes, (keys.agg(F.sum("n")).first()[0] or 0) >> PAGES_LOG)
    chained = materialise(keys.where(F.col("n") > page).select("h", F.ceil(F.col("n") / page).alias("pages")), "dedup-overflow")
    slots = materialise(directory(keys.where(F.col("n") <= page), page, level), "dedup-slots")
    discard(keys)

    single = _paged(leaf.drop("row").join(chained, "h", "left_anti"), slots).withColumn("overflow", F.lit(None).cast("long"))
    spread = leaf.join(chained, "h").select("h", "id", "x", "sha", F.lit(KEY_BITS).alias("depth"), F.col("h").alias("bucket"), F.pmod("row", "pages").alias("overflow"))
    owned = single.unionByName(spread).repartition("depth", "bucket", "overflow")
    found = owned.groupBy("depth", "bucket", "overflow", "h", "sha", "x").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # only texts on overflow pages are needed once more
    found = materialise(found.select("h", "sha", "keep_id", "group_size", "overflow", F.when(F.col("overflow").isNotNull(), F.col("x")).alias("x")), "dedup-groups")
    groups = found.where("overflow is null").select("h", "sha", "keep_id", "group_size")
    over = found.where("overflow is not null").groupBy("h", "sha", "x").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = groups.union(over.drop("x"))

    out = leaf.select("id", "h", "sha").join(groups, ["h", "sha"])
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x
  from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by x)
"""
