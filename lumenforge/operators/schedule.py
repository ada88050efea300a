"""Weekly intervals: grids, lanes, consecutive items, calendars."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def grid_load(items: DataFrame, day: str, start: str, end: str, amount: str, step: int = 60, first: int = 0, last: int = 1440) -> DataFrame:
    """(day, minute, load): the amount of all items that cover each minute of the grid; only covered minutes have rows."""
    low = F.greatest(F.lit(first), F.ceil(F.col(start) / step) * step)
    high = F.least(F.lit(last - step), F.ceil(F.col(end) / step) * step - step)
    at = items.where(low <= high).withColumn("minute", F.explode(F.sequence(low.cast("long"), high.cast("long"), F.lit(step).cast("long"))))
    return at.groupBy(day, "minute").agg(F.sum(amount).alias("load"))


def idle_days(items: DataFrame, key: str, day: Column, first: str, last: str) -> DataFrame:
    """(key, idle_days): for every key of ``items`` how many days from ``first`` to ``last`` have no item of it.

    Days outside are not counted, so that a key whose items all lie outside has every day idle. Null days are none.
    """
    span = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    inside = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)
    return items.groupBy(key).agg((span - F.count_distinct(inside)).cast("long").alias("idle_days"))


def consecutive(items: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Every item with the next one of its key (``next_`` columns), where there is one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = items.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where(F.col(f"next_{columns[0]}").isNotNull())


def clusters(items: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Adds ``cluster``: runs of items of a key in which each begins before an earlier one has ended."""
    w = Window.partitionBy(*keys).orderBy(start, end, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) >= reach).cast("int"), F.lit(1))
    return items.withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_f")


def lanes(items: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Adds ``cluster``, ``lane`` (the first one free) and ``lane_count`` of the cluster, each cluster on its own.

    A task walks its keys' items in order and holds the open lanes of one cluster, so the number of clusters costs nothing. Items without a start
    come last in their cluster; one without an end keeps its lane.
    """
    rows = clusters(items.repartition(*keys), keys, start, end, tie)
    order = [F.asc_nulls_last(c) for c in (start, end, tie)]
    first = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy(*order)) == 1
    rows = rows.withColumn("_first", first).sortWithinPartitions(*keys, "cluster", *order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy: list[tuple] = []  # (end, lane) of items that may end, and the lanes free again
        free: list[int] = []
        used = 0
        for batch in batches:
            lane = []
            for fresh, a, b in zip(*(batch.column(c).to_pylist() for c in ("_first", start, end)), strict=True):
                if fresh:
                    busy, free, used = [], [], 0
                while a is not None and busy and busy[0][0] <= a:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if a is not None and free:
                    k = heapq.heappop(free)
                else:
                    k, used = used, used + 1
                if b is not None:
                    heapq.heappush(busy, (b, k))
                lane.append(k)
            kept = batch.drop_columns(["_first"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lane, pa.int64())], names=[*kept.schema.names, "lane"])

    schema = StructType([*rows.drop("_first").schema.fields, StructField("lane", LongType())])
    count = F.max("lane").over(Window.partitionBy(*keys, "cluster")) + 1
    return rows.mapInArrow(place, schema).withColumn("lane_count", count)
