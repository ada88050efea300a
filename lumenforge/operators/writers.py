"""Writers: snapshots after an update, as new tables; and the checks that hold an update back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of records and of filled values that a run may lose, and the size up to which shares say nothing; fixed values.
MAX_RECORD_DROP, MAX_FILLED_DROP, SMALL = 0.3, 0.5, 3
DAY_MINUTES = 1440


def soft_deleted(rows: DataFrame, gone: DataFrame, keys: Sequence[str], stamp: str, now: Column) -> DataFrame:
    """Rows with ``stamp`` set to ``now`` where their key is in ``gone``; a stamp is never set twice."""
    mark = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return rows.join(mark, list(keys), "left").withColumn(stamp, F.coalesce(stamp, F.when(F.col("_gone"), now))).drop("_gone")


def stamped_from_last(events: DataFrame, readings: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """Events with the last value read at or before their time, null where there is none.

    Both sides go through one window a key, so a key's history is sorted once and never multiplied.
    """
    columns = events.columns
    event = F.struct(*columns)
    a = readings.select(key, ts, F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("_e"))
    b = events.select(key, ts, F.lit(1).alias("_side"), F.lit(None).cast(readings.schema[value].dataType).alias("_v"), event.alias("_e"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(name, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_e.*", name)


def replaced_plans(plans: DataFrame, sections: DataFrame, owner: str) -> DataFrame:
    """(owner, plan, section, position, start, end, is_primary): a person's plans as sent, made sound.

    ``plans`` (owner, plan, created, flagged, section, pos, start, end). Unknown sections are dropped and positions renumbered from 0 (equal ones by section, then time), minutes
    are held to the day, and exactly one plan is primary: the first flagged one, else the oldest; plans all of whose sections are unknown are gone.
    """
    known = plans.join(sections.select("section").distinct(), "section", "left_semi")
    place = F.row_number().over(Window.partitionBy(owner, "plan").orderBy("pos", "section", "start", "end")) - 1
    first = known.groupBy(owner).agg(F.min_by("plan", F.struct((~F.coalesce("flagged", F.lit(False))), "created", "plan")).alias("_primary"))
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(DAY_MINUTES), F.col(c))).cast("long")
    return known.join(first, owner).select(owner, "plan", "section", place.cast("long").alias("position"), held("start").alias("start"), held("end").alias("end"), (F.col("plan") == F.col("_primary")).alias("is_primary"))


def quarantined(runs: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with ``reason``, null where a run may be written. Both sides have (keys, records, filled).

    Incoherent counts (missing, negative, more filled than records) hold a run back; so do no records where there were some, too large a loss of
    records or of filled values where there were more than ``SMALL``, and the loss of all filled values. A first run, or one after nothing, may be written.
    """
    joined = runs.join(previous.select(*keys, F.col("records").alias("_pr"), F.col("filled").alias("_pf"), F.lit(True).alias("_had")), list(keys), "left")
    r, f, pr, pf = (F.col(c) for c in ("records", "filled", "_pr", "_pf"))
    wrong = lambda a, b: a.isNull() | b.isNull() | (a < 0) | (b < 0) | (b > a)
    reason = (
        F.when(wrong(r, f) | F.coalesce(F.col("_had") & wrong(pr, pf), F.lit(False)), "incoherent")
        .when(F.col("_had").isNull() | (pr == 0), None)
        .when(r == 0, "empty")
        .when((pr > SMALL) & ((pr - r) / pr > MAX_RECORD_DROP), "records")
        .when((pf > SMALL) & ((pf - f) / pf > MAX_FILLED_DROP), "filled")
        .when((pf > 0) & (f == 0), "all filled lost")
    )
    return joined.select(*runs.columns, reason.alias("reason"))


def folder_deleted(members: DataFrame, folders: DataFrame, bookmarks: DataFrame, with_members: bool) -> tuple[DataFrame, DataFrame]:
    """(members, bookmarks) after folders go; ``with_members`` also deletes the bookmarks that lay in them."""
    gone = folders.select("folder").distinct()
    kept = bookmarks.join(members.join(gone, "folder", "left_semi").select("bookmark"), "bookmark", "left_anti") if with_members else bookmarks
    return members.join(gone, "folder", "left_anti").join(kept.select("bookmark"), "bookmark", "left_semi").select(*members.columns), kept
