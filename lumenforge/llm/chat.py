"""Chat formatting: collapse cumulative snapshots of conversations and render the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.llm.common import materialise


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk_turns: int = 256,
) -> DataFrame:
    """Keep maximal conversations of a log of cumulative snapshots and render them.

    Each turn gets a rolling hash of all turns up to it (two 64-bit lanes, combined by
    exclusive or of position-salted hashes). A conversation whose last hash is a proper
    turn prefix of another is anti-joined away; of equal ones the smallest id stays.
    Returns conv_id, part, n_turns, copies (equal conversations, itself included), text:
    turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. A conversation is rendered in parts of
    the turn numbers ``[k * chunk_turns, (k + 1) * chunk_turns)``, so no task holds more.

    Null role or text counts as empty, null turns sort first, rows that repeat a whole turn
    count once, turns that share a number sort by role and text hash, a null conversation
    id is a conversation of its own. Empty input gives no rows; other columns are ignored.
    """
    base = turns.select(
        F.col(conv).alias("c"),
        F.col(turn).cast("long").alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"),
    ).withColumn("k", F.floor(F.col("t") / F.lit(chunk_turns)))
    hashed = base.select("c", "k", "t", F.xxhash64(F.lit(1), "r", "x").alias("h1"), F.xxhash64(F.lit(2), "r", "x").alias("h2"), "r")

    order = Window.partitionBy("c", "k").orderBy(F.asc_nulls_first("t"), "r", "h1", "h2")
    row = F.struct("t", "r", "h1", "h2")
    once = hashed.withColumn("again", row.eqNullSafe(F.lag(row).over(order))).where("not again").withColumn("i", F.row_number().over(order))

    def carried(chunks: DataFrame, *exprs) -> DataFrame:
        """What the earlier chunks of each conversation add up to."""
        w = Window.partitionBy("c").orderBy(F.asc_nulls_first("k")).rowsBetween(Window.unboundedPreceding, -1)
        return chunks.select("c", "k", *(F.coalesce(e.over(w), F.lit(0)).alias(n) for n, e in exprs), *(F.col(x) for x in chunks.columns if x not in ("c", "k")))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"c": "rc", "k": "rk"})
        return left.join(r, left.c.eqNullSafe(r.rc) & left.k.eqNullSafe(r.rk)).drop("rc", "rk")

    sizes = carried(once.groupBy("c", "k").agg(F.count("*").alias("n")), ("before", F.sum("n")))
    placed = joined(once, sizes.select("c", "k", "before")).withColumn("pos", F.col("before") + F.col("i"))
    salted = placed.select("c", "k", "pos", *(F.xxhash64("pos", "r", f"h{j}").alias(f"e{j}") for j in (1, 2)))
    lanes = carried(salted.groupBy("c", "k").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2")), ("q1", F.bit_xor("s1")), ("q2", F.bit_xor("s2")))
    run = Window.partitionBy("c", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = salted.select("c", "k", "pos", F.bit_xor("e1").over(run).alias("x1"), F.bit_xor("e2").over(run).alias("x2"))
    totals = sizes.groupBy("c").agg(F.sum("n").alias("n_turns")).withColumnRenamed("c", "tc")
    prefixes = joined(rolled, lanes.select("c", "k", "q1", "q2")).select("c", "pos", F.col("x1").bitwiseXOR(F.col("q1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("q2")).alias("p2"))
    prefixes = prefixes.join(totals, prefixes.c.eqNullSafe(totals.tc)).drop("tc")
    prefixes = materialise(prefixes, "chat-prefixes")

    whole = prefixes.where("pos = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min_by("c", F.struct(F.col("c").isNull(), "c")).alias("c"), F.count("*").alias("copies"))
    proper = prefixes.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    kept = whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select(F.col("c").alias("kc"), "n_turns", "copies")

    said = base.join(kept, base.c.eqNullSafe(kept.kc))
    parts = said.groupBy("c", "k", "n_turns", "copies").agg(
        F.sort_array(F.collect_set(F.struct("t", "r", F.xxhash64(F.lit(1), "r", "x").alias("h1"), F.xxhash64(F.lit(2), "r", "x").alias("h2"), "x"))).alias("a")
    )
    spoken = F.array_join(F.transform("a", lambda z: F.concat(F.lit("<|im_start|>"), z["r"], F.lit("\n"), z["x"], F.lit("<|im_end|>\n"))), "")
    number = F.row_number().over(Window.partitionBy("c").orderBy(F.asc_nulls_first("k"))) - 1
    return parts.select(F.col("c").alias("conv_id"), number.cast("long").alias("part"), "n_turns", "copies", spoken.alias("text"))


ORACLE_SQL = """
with base as (
  select distinct conv_id as c, turn as t, coalesce(role, '') as r, coalesce(text, '') as x from conversations
), told as (
  select c, t, row_number() over w as pos, count(*) over (partition by c) as n,
         string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10), '') over w as said
  from base window w as (partition by c order by t, r, x rows unbounded preceding)
), finals as (
  select min(c) as conv_id, n, count(*) as copies, said from told where pos = n group by n, said
)
select conv_id, 0::bigint as part, n as n_turns, copies, said as text from finals f
where not exists (select 1 from told p where p.pos < p.n and p.pos = f.n and p.said = f.said)
"""
