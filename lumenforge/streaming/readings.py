"""Readings as streams: opened seats, captured snapshots and watched keys."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Keys that a user may watch at once, a fixed value.
WATCHED = 60


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors both see: under ``spark.checkpoint.dir``; where that is unset, the warehouse on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def opened(readings: DataFrame, key: str, ts: str, tie: str, is_open: str) -> DataFrame:
    """Append-mode stream of readings that are open while their key's reading before was not.

    ``is_open`` names a boolean column (null counts as closed). State is one row a key: the last instant and tie seen, and whether it
    was open. A key's first reading is no transition; rows with a null key or instant are ignored; a reading older than the last one
    seen in an earlier batch comes too late to change the history and is ignored. A batch sorts one key's rows in one task, so bound
    the batch (``maxFilesPerTrigger``) rather than the key.
    """
    out = T.StructType([readings.schema[key], readings.schema[tie], readings.schema[ts]])
    state = T.StructType([T.StructField("ts", T.LongType()), T.StructField("tie", readings.schema[tie].dataType), T.StructField("open", T.BooleanType())])

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["_us", tie], kind="stable")
        if held.exists:
            us, t, was = held.get
            rows = rows[(rows["_us"] > us) | ((rows["_us"] == us) & (rows[tie] > t))]
        if rows.empty:
            return
        now = rows["_open"].astype(bool)
        before = now.shift(fill_value=bool(was) if held.exists else True)  # a first reading never opens
        last = rows.iloc[-1]
        held.update((int(last["_us"]), last[tie].item() if hasattr(last[tie], "item") else last[tie], bool(now.iloc[-1])))
        yield rows.loc[now & ~before, [key, tie, ts]]

    rows = readings.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, tie, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.coalesce(F.col(is_open), F.lit(False)).alias("_open")
    )
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def opened_in_order(readings: DataFrame, key: str, ts: str, tie: str, is_open: str) -> DataFrame:
    """As ``opened``, of a table of drained readings in whatever order they came: each key's history is read in event order."""
    rows = readings.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_open", F.coalesce(F.col(is_open), F.lit(False)))
    seen = rows.withColumn("_was", F.lag("_open").over(Window.partitionBy(key).orderBy(ts, tie)))
    return seen.where("_open and not _was").select(key, tie, ts)


def captured(readings: DataFrame, key: str, ts: str, value: str, within: str | None = "1 hour") -> DataFrame:
    """Append-mode stream with one row a key and instant: rows without a value go, repeats within ``within`` go.

    Rows that come later than ``within`` are lost; with None no row is late, and the state keeps every key and instant.
    """
    timed = readings.where(F.col(value).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    if within is None:
        return timed.dropDuplicates([key, ts])
    return timed.withWatermark(ts, within).dropDuplicatesWithinWatermark([key, ts])


def watched_latest(readings: DataFrame, watched: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Complete-mode stream with the last reading of each watched key; more than WATCHED keys are an error, so that ``watched`` may be broadcast."""
    keys = watched.select(key).distinct().limit(WATCHED + 1)
    if keys.count() > WATCHED:
        raise ValueError(f"more than {WATCHED} keys are watched")
    mine = readings.join(F.broadcast(keys), key, "left_semi")
    return mine.groupBy(key).agg(F.max_by(F.struct(*[c for c in mine.columns if c != key]), F.struct(ts, tie)).alias("_r")).select(key, "_r.*")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet in the shared folder, and read that.

    In complete mode each batch replaces the one before, in a folder of its own, so a retried batch writes the same rows.
    """
    spark = stream.sparkSession
    at = shared_path(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").option("path", f"{at}/rows").start()
    else:
        spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows")  # stays when the source holds nothing
        run = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
