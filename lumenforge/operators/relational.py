"""Joins, windows and set operations that the catalog queries are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts into which a grid of series and instants is dealt.
SPREAD = 64


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in the given order; the order should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, position: str | None = None) -> DataFrame:
    """At most ``limit`` rows of every key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    return out.withColumnRenamed("_rank", position) if position else out.drop("_rank")


def dense_counts(ids: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A count for every id asked for, zero where there are no facts; facts are counted before the join."""
    return ids.select(key).distinct().join(facts.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def fallback_join(left: DataFrame, first: DataFrame, second: DataFrame, first_on: Sequence[str], second_on: Sequence[str], value: str) -> DataFrame:
    """``value`` by the first key, else by the second; both sides must be unique on their key."""
    a = first.select(*first_on, F.col(value).alias("_a"))
    b = second.select(*second_on, F.col(value).alias("_b"))
    return left.join(a, list(first_on), "left").join(b, list(second_on), "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def unique_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that name exactly one value; ambiguous keys are left out."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_high")).where(F.col(value) == F.col("_high")).drop("_high")


def overlapping_pairs(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of half-open intervals of a key that overlap, once each, the smaller id first.

    Intervals are dealt to buckets of time, so an equi-join on key and bucket replaces the range
    join; a pair is reported in the bucket where the later one starts. Empty intervals overlap nothing.
    """
    rows = df.where(F.col(start) < F.col(end)).select(*keys, id_col, start, end)
    last = F.floor((F.col(end) - 1) / bucket)
    rows = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), last)))
    other = rows.select(*keys, "_b", F.col(id_col).alias("other_id"), F.col(start).alias("other_start"), F.col(end).alias("other_end"))
    hit = (F.col(start) < F.col("other_end")) & (F.col("other_start") < F.col(end)) & (F.col(id_col) < F.col("other_id"))
    first = F.floor(F.greatest(start, "other_start") / bucket) == F.col("_b")
    return rows.join(other, [*keys, "_b"]).where(hit & first).drop("_b")


def ranked_earlier(targets: DataFrame, sources: DataFrame, on: Sequence[str], when: str, prefer: Column, source_cols: Sequence[str], tie: str) -> DataFrame:
    """For every target the earlier source of its key that ``prefer`` puts first, then the latest."""
    s = sources.select(*on, *[F.col(c).alias(f"src_{c}") for c in {when, tie, *source_cols}])
    joined = targets.join(s, list(on)).where(F.col(f"src_{when}") < F.col(when))
    w = Window.partitionBy(tie).orderBy(prefer.desc(), F.col(f"src_{when}").desc(), F.col(f"src_{tie}").desc())
    return joined.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def carry_forward(df: DataFrame, series: str, instant: str, value: str) -> DataFrame:
    """Every series at every instant that any of them has, with its last value so far (null before its first)."""
    # the grid is the result's own size; instants are dealt to SPREAD tasks, each with all series
    instants = df.select(instant).distinct().withColumn("_k", F.pmod(F.xxhash64(instant), F.lit(SPREAD)))
    names = df.select(series).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    grid = names.join(instants, "_k").drop("_k")
    w = Window.partitionBy(series).orderBy(instant).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df, [series, instant], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def rescale(df: DataFrame, score: str, low: float, high: float, name: str) -> DataFrame:
    """Scores stretched to [low, high] by the table's minimum and maximum; all equal gives ``high``."""
    bounds = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    out = df.join(F.broadcast(bounds))
    return out.withColumn(name, F.when(span == 0, F.lit(high)).otherwise(low + (high - low) * (F.col(score) - F.col("_lo")) / span)).drop("_lo", "_hi")


def banded_order(df: DataFrame, score: str, personal: str, tie: str, width: float = 0.02) -> DataFrame:
    """Rows with their place when bands of the top score order first, the personal score within a band, then score and id."""
    top = df.agg(F.max(score).alias("_top"))
    rows = df.join(F.broadcast(top)).withColumn("band", F.floor(F.col(score) / (F.col("_top") * width)).cast("long")).drop("_top")
    return rows.orderBy(F.desc("band"), F.desc(personal), F.desc(score), F.asc(tie))
