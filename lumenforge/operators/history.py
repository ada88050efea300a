"""Time series of readings: transitions, changes, edges of windows, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def open_transitions(readings: DataFrame, key: str, ts: str, tie: str, is_open: Column, since: str) -> DataFrame:
    """Readings since ``since`` that are open while the one before them was not.

    Only rows of the window and one earlier row of each key are compared; a key's first reading is no transition.
    """
    rows = readings.withColumn("is_open", F.coalesce(is_open, F.lit(False)))
    at = F.lit(since).cast("timestamp_ntz")
    prior = rows.where(F.col(ts) < at).groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(ts, tie)).alias("_r")).select("_r.*")
    w = Window.partitionBy(key).orderBy(ts, tie)
    seen = rows.where(F.col(ts) >= at).unionByName(prior).withColumn("was_open", F.lag("is_open").over(w))
    return seen.where((F.col(ts) >= at) & F.col("is_open") & ~F.col("was_open")).drop("was_open", "is_open")


def changed_readings(readings: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Readings that differ, null-safely, from the one before; the first of a key stays."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return readings.withColumn("_same", same).where("not _same").drop("_same")


def with_left_edge(readings: DataFrame, key: str, ts: str, tie: str, since: str) -> DataFrame:
    """Readings since ``since`` and, for each key, the last one before."""
    at = F.lit(since).cast("timestamp_ntz")
    edge = readings.where(F.col(ts) < at).groupBy(key).agg(F.max_by(F.struct(*readings.columns), F.struct(ts, tie)).alias("_r")).select("_r.*")
    return readings.where(F.col(ts) >= at).unionByName(edge)


def used_in_range(readings: DataFrame, key: str, ts: str, amount: Column, seconds: int, name: str) -> DataFrame:
    """What each key has used within the seconds up to and including each reading."""
    w = Window.partitionBy(key).orderBy(F.col("_t")).rangeBetween(-seconds * 1_000_000, 0)
    rows = readings.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.withColumn(name, F.sum(amount).over(w)).drop("_t")
