"""Windows that begin at a key's first hit: pointers to the next window, doubled until every window is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.operators.graph import checkpointed

#: A key's rows are cut at least this often, in microseconds: no task gets a busy key's whole history.
SPAN = 24 * 3600 * 1_000_000


def latest_at(points: DataFrame, probes: DataFrame, key: str, at: str, found: str, span: int = SPAN) -> DataFrame:
    """``probes`` with ``found``: the greatest ``at`` of the key's ``points`` that is not beyond the probe's, null where there is none.

    Keys are cut into spans of ``at``; within one a running maximum answers, and a span without an earlier point takes the last one of the spans before.
    """
    p = points.select(key, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_row"))
    q = probes.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    rows = p.unionByName(q).withColumn("_span", F.floor(F.col("_at") / span))
    point = F.when(F.col("_kind") == 0, F.col("_at"))
    inside = F.max(point).over(Window.partitionBy(key, "_span").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.groupBy(key, "_span").agg(F.max(point).alias("_top"))
    before = F.max("_top").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(key, "_span", before.alias("_before"))
    got = rows.withColumn("_in", inside).where("_kind = 1").join(spans, [key, "_span"])
    return got.select("_row.*", F.coalesce("_in", "_before").alias(found))


def window_starts(hits: DataFrame, key: str, at: str, length: int) -> DataFrame:
    """(key, at) of the hits that begin a window: the first hit, then each first one at or beyond the end of the window before.

    Every hit points at the first one ``length`` later; pointers are doubled, so that a round doubles the number of windows known of each key.
    """
    inst = checkpointed(hits.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct())
    # the first hit not before an instant is the last one not beyond it on a reversed clock
    ask = inst.select(key, (-(F.col(at) + length)).alias(at), F.col(at).alias("_from"))
    back = latest_at(inst.withColumn(at, -F.col(at)), ask, key, at, "_to")
    jumps = checkpointed(back.where("_to is not null").select(key, F.col("_from").alias(at), (-F.col("_to")).alias("_to")))
    starts = inst.groupBy(key).agg(F.min(at).alias(at))
    while True:
        new = checkpointed(starts.join(jumps, [key, at]).select(key, F.col("_to").alias(at)))
        if new.isEmpty():
            return starts
        starts = checkpointed(starts.unionByName(new))
        on = jumps.select(key, F.col(at).alias("_to"), F.col("_to").alias("_next"))
        jumps = checkpointed(jumps.join(on, [key, "_to"]).select(key, at, F.col("_next").alias("_to")))


def first_hit_windows(hits: DataFrame, key: str, ts: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """``hits`` with window_start, place, allowed, remaining and retry_after_s by a limit of hits a window.

    A window begins with a key's first hit, or the first one at or beyond the end of the last window, and ends ``seconds`` later; ``place`` counts its
    hits in order of ``ts`` and ``tie``, those beyond the limit included. Hits without a key or an instant are left out.
    """
    length = seconds * 1_000_000
    rows = hits.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    got = latest_at(window_starts(rows, key, "_t", length), rows, key, "_t", "_start")
    place = F.row_number().over(Window.partitionBy(key, "_start").orderBy("_t", tie)).cast("long")
    left = (F.col("_start") + length - F.col("_t")) / 1_000_000
    return (
        got.withColumn("place", place)
        .withColumn("allowed", F.col("place") <= limit)
        .withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("place")))
        .withColumn("retry_after_s", F.greatest(F.lit(1).cast("long"), F.ceil(left)))
        .withColumn("window_start", F.timestamp_micros("_start").cast(hits.schema[ts].dataType))
        .drop("_t", "_start")
    )
