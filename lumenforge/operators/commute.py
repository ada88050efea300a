"""Ways between a day's items: the walk that each asks for, the gap there is, and how much it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slack below which a walk is tight, metres walked in a minute, how much longer streets are than a straight line, the earth's radius; fixed values.
TIGHT_MINUTES, METRES_A_MINUTE, STREET_FACTOR, EARTH_METRES = 5, 78, 1.3, 6_371_000
UNKNOWN = "unknown"


def straight_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres between two places."""
    half = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_METRES * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def legs(items: DataFrame, places: DataFrame, walks: DataFrame, person: str, day: str, is_remote: Column) -> DataFrame:
    """(person, day, item, next_item, from_zone, to_zone, gap, walk, feasible, cross) of consecutive items of a day that somebody walks between.

    ``items`` has (person, day, item, start, end, place) in minutes, place null where unknown; ``places`` (place, zone, lat, lng), which may lack
    coordinates; ``walks`` (from_zone, to_zone, minutes, cross) has every pair of zones, ``unknown`` included, and is broadcast. Overlapping items, those
    in one place and those of which one is remote (``is_remote`` on items) give no leg. Within a known zone coordinates refine the zones' estimate.
    """
    w = Window.partitionBy(person, day).orderBy("start", "end", "item")
    own = items.withColumn("_remote", F.coalesce(is_remote, F.lit(False)))
    ahead = {c: F.lead(c).over(w) for c in ("item", "start", "place", "_remote")}
    pairs = own.select("*", *(x.alias(f"_next_{c}") for c, x in ahead.items())).withColumn("gap", F.col("_next_start") - F.col("end"))
    pairs = pairs.where((F.col("gap") >= 0) & ~F.col("_remote") & ~F.col("_next__remote") & ~F.coalesce(F.col("place") == F.col("_next_place"), F.lit(False)))
    ends = [places.select(F.col("place").alias(f"_{k}"), *(F.col(c).alias(f"_{k}_{c}") for c in ("zone", "lat", "lng"))) for k in ("from", "to")]
    met = pairs.join(ends[0], F.col("place") == F.col("_from"), "left").join(ends[1], F.col("_next_place") == F.col("_to"), "left")
    met = met.withColumns({f"{k}_zone": F.coalesce(f"_{k}_zone", F.lit(UNKNOWN)) for k in ("from", "to")})
    met = met.join(F.broadcast(walks), ["from_zone", "to_zone"], "left")
    at = [F.col(f"_{k}_{c}") for k in ("from", "to") for c in ("lat", "lng")]
    walked = F.greatest(F.lit(1.0), F.round(straight_metres(*at) * STREET_FACTOR / METRES_A_MINUTE))
    refined = F.when((F.col("from_zone") == F.col("to_zone")) & (F.col("from_zone") != UNKNOWN), walked)
    walk = F.coalesce(refined, F.col("minutes")).cast("long")
    out = met.withColumn("walk", walk).withColumn("feasible", F.col("gap") >= F.col("walk"))
    return out.select(person, day, "item", F.col("_next_item").alias("next_item"), "from_zone", "to_zone", "gap", "walk", "feasible", F.coalesce("cross", F.lit(False)).alias("cross"))


def with_severity(found: DataFrame, tight: int = TIGHT_MINUTES) -> DataFrame:
    """Legs worth a word, with ``severity``.

    A walk that does not fit is hard between known zones and soft otherwise; a way across campuses is hard without slack and soft with it; another
    tight one is soft.
    """
    known = (F.col("from_zone") != UNKNOWN) & (F.col("to_zone") != UNKNOWN)
    slack = F.col("gap") - F.col("walk")
    severity = (
        F.when(~F.col("feasible"), F.when(known, "hard").otherwise("soft"))
        .when(known & F.col("cross"), F.when(slack < tight, "hard").otherwise("soft"))
        .when(slack < tight, "soft")
    )
    return found.withColumn("severity", severity).where("severity is not null")


def minutes_by_day(found: DataFrame, person: str, day: str) -> DataFrame:
    return found.groupBy(person, day).agg(F.sum("walk").alias("walk"), F.count("*").alias("legs"))
