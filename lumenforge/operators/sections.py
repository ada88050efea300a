"""Filters and lookups of sections: windows of time, seats, schools, names, folders, places."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places up to which a list of names is compared with every text.
PLACES = 10_000


def within_window(items: DataFrame, keys: Sequence[str], start: str, end: str, after: int, before: int) -> DataFrame:
    """Keys all of whose items lie in [after, before]; an item without a start or an end fails its key."""
    known = F.coalesce((F.col(start) >= after) & (F.col(end) <= before), F.lit(False))
    return items.groupBy(*keys).agg(F.bool_and(known).alias("_in")).where("_in").drop("_in")


def open_only(rows: DataFrame, seats: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is open by ``seats`` (key, open); without seats every row stays, unknown ones do not otherwise."""
    return rows if seats is None else rows.join(seats.where("open").select(key).distinct(), key, "left_semi")


def named_by_query(sections: DataFrame, course: Sequence[str], title: Column, words: Sequence[str]) -> DataFrame:
    """Of each course the sections whose title has most of the words; none where all tie or nothing is found. A null title has none."""
    n = sum((F.coalesce(title.contains(w).cast("int"), F.lit(0)) for w in words), F.lit(0))
    w = Window.partitionBy(*course)
    marked = sections.withColumn("_n", n).withColumn("_best", F.max("_n").over(w)).withColumn("_worst", F.min("_n").over(w))
    return marked.where("_n = _best and _worst < _best").drop("_n", "_best", "_worst")


def admitted(courses: DataFrame, course: str, qualifier: Column, own: Collection[str], others: Collection[str], shared: str, barred: DataFrame) -> DataFrame:
    """Courses open to a school: qualifiers of its ``own`` pass, those of ``others`` do not, ``shared`` ones pass unless ``barred`` (course) names them.

    Other and missing qualifiers pass.
    """
    q = F.coalesce(qualifier, F.lit(""))
    listed = barred.select(course).distinct().withColumn("_barred", F.lit(True))
    ok = F.when(q.isin(*own), True).when(q.isin(*others), False).when(q == shared, F.col("_barred").isNull()).otherwise(True)
    return courses.join(listed, course, "left").where(ok).drop("_barred")


def folder_counts(bookmarks: DataFrame, person: str, folders: str) -> DataFrame:
    """(person, folder, n): ``all``, ``uncategorized`` and each folder; a bookmark in several folders counts in each. A null list is an empty one."""
    given = F.coalesce(folders, F.array().cast("array<string>"))
    names = F.concat(F.array(F.lit("all")), F.when(F.size(given) == 0, F.array(F.lit("uncategorized"))).otherwise(F.array().cast("array<string>")), given)
    counted = bookmarks.select(person, F.explode(names).alias("folder")).groupBy(person, "folder").agg(F.count("*").alias("n"))
    none = counted.select(person).distinct().select(person, F.lit("uncategorized").alias("folder"), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(none).groupBy(person, "folder").agg(F.max("n").alias("n"))


def contained_match(rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, building) of rows (key, text) by places (building, name): an equal name first, else one that contains the other; the least building wins.

    The places are a list of a campus: more than ``PLACES`` are an error, so that comparing each text with them stays a bounded scan of the rows.
    """
    names = [(r.building, r.name) for r in places.where("name <> ''").select("building", "name").limit(PLACES + 1).collect()]
    if len(names) > PLACES:
        raise ValueError(f"more than {PLACES} places to compare texts with")
    if not names:
        return rows.select(key, F.lit(0).cast("long").alias("building")).where(F.lit(False))
    listed = F.array(*[F.struct(F.lit(b).cast("long").alias("building"), F.lit(n).alias("name")) for b, n in names])
    text = F.when(F.col("text") != "", F.col("text"))
    hits = F.filter(F.transform(listed, lambda p: F.struct(F.when(text == p["name"], 0).when(text.contains(p["name"]) | p["name"].contains(text), 1).alias("pass"), p["building"].alias("building"))), lambda h: h["pass"].isNotNull())
    return rows.select(key, F.array_min(hits).alias("_h")).where("_h is not null").select(key, F.col("_h.building").alias("building"))
