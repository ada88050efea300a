"""Checks of plans over terms: prerequisites, corequisites, duplicates, equivalents and loads, for all terms in one pass over the trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.operators import prerequisites as pre

#: Points of a full-time term, and those beyond which a term needs approval; fixed values.
LEAST_POINTS, MOST_POINTS = 12, 18


def _unmet(placed: DataFrame, first: DataFrame, parsed: DataFrame, clause: str, person: str, term: str, course: str, max_depth: int) -> DataFrame:
    """(person, course, term, options): each open choice of a placed course's clause. A leaf is met by the first term of its course: earlier, or for what may stand beside, not later."""
    tree = pre.nodes(parsed, course, clause)
    ask = placed.select(person, course, term).distinct()
    due = F.col("_first") < F.col(term) if clause == "before" else F.col("_first") <= F.col(term)
    keys = [person, course, term]
    met = pre.met_leaves(ask, tree, first.withColumnRenamed(course, "value"), [*keys, "_first"], course, [person, "value"])
    roots = pre.folded(ask, tree, met.where(due).select(*keys, "value"), keys, course, max_depth)
    return roots.where(F.col("status") == pre.UNMET).select(person, course, term, F.explode("outstanding").alias("options"))


def check_plans(plan: DataFrame, courses: DataFrame, parsed: DataFrame, equivalents: DataFrame, person: str, term: str, place: str, course: str, max_depth: int = 6) -> DataFrame:
    """(person, term, place, course, kind, severity, resolved_by, other) of everything that is wrong with the plans.

    ``plan`` has (person, term, place, course), one row for each place of a term, terms as numbers in order; ``courses`` (course, points), points null where
    unknown; ``parsed`` is what ``prerequisites.parse`` gives, by course; ``equivalents`` (course, other) in both directions.

    A course is met where its first term lies before (a prerequisite) or not after (a corequisite) the term that asks; so every term is judged by
    one join with first terms and one fold of the trees, not by a set that grows from term to term. ``resolved_by`` holds the courses of which one would
    settle a choice; a choice of courses that are all unknown is assumed taken elsewhere. ``other`` names an equivalent course placed before. Courses that
    are not in ``courses`` are only reported as such. A term's points are those known; it is light only if none is unknown. Rows with null keys are left out.
    """
    keys = [person, term, place, course]
    plan = plan.select(*keys).where(F.col(person).isNotNull() & F.col(term).isNotNull() & F.col(course).isNotNull())
    first = plan.groupBy(person, course).agg(F.min(term).alias("_first"))
    catalog = courses.select(course, "points").dropDuplicates([course]).withColumn("_known", F.lit(True))
    all_placed = plan.join(catalog, course, "left").withColumn("_before", F.lag(term).over(Window.partitionBy(person, course).orderBy(term, place)))
    known = all_placed.where("_known")
    none = F.array().cast("array<string>")

    def issues(rows: DataFrame, kind, severity, options=none, other=None) -> DataFrame:
        said = [x if not isinstance(x, str) else F.lit(x) for x in (kind, severity)]
        return rows.select(*keys, said[0].alias("kind"), said[1].alias("severity"), options.alias("resolved_by"), (F.lit(None) if other is None else other).cast("string").alias("other"))

    mine = known.select(*keys)
    duplicate = issues(all_placed.where("_before is not null"), "duplicate_course", "error")
    unknown = issues(all_placed.where("_known is null"), "unknown_course", "warning")

    earlier = plan.select(person, F.col(course).alias("other"), F.col(term).alias("_t"), F.col(place).alias("_p"))
    pairs = mine.join(equivalents.select(course, "other").distinct(), course).join(earlier, [person, "other"])
    pairs = pairs.where((F.col("_t") < F.col(term)) | ((F.col("_t") == F.col(term)) & (F.col("_p") < F.col(place)))).dropDuplicates([*keys, "other"])
    equivalent = issues(pairs, "equivalent_conflict", "warning", other=F.col("other"))

    permission = parsed.select(course, F.coalesce("permission", F.lit(False)).alias("_permission"), "advisories")
    there = catalog.select(F.col(course).alias("_o"), F.lit(True).alias("_in"))
    before = _unmet(mine, first, parsed, "before", person, term, course, max_depth).distinct()
    inside = before.select("options", F.explode("options").alias("_o")).distinct().join(there, "_o", "left").groupBy("options").agg(F.bool_or(F.coalesce("_in", F.lit(False))).alias("_inside"))
    before = mine.join(before, [person, course, term]).join(inside, "options").join(permission, course, "left")
    kind = F.when(F.col("_inside"), "prereq_unmet").otherwise("prereq_external")
    severity = F.when(F.col("_inside") & ~F.coalesce("_permission", F.lit(False)), "error").otherwise("warning")
    needed = issues(before, kind, severity, F.col("options"))

    beside = mine.join(_unmet(mine, first, parsed, "beside", person, term, course, max_depth).distinct(), [person, course, term])
    corequisite = issues(beside, "corequisite_unmet", "error", F.col("options"))
    told = mine.join(permission, course).withColumn("other", F.explode("advisories"))
    advisory = issues(told, "prereq_unknown", "info", other=F.col("other"))

    terms = all_placed.groupBy(person, term).agg(F.coalesce(F.sum("points"), F.lit(0)).alias("_points"), F.count_if(F.col("_known") & F.col("points").isNull()).alias("_open"))
    load = F.when(F.col("_points") > MOST_POINTS, "over_load").when((F.col("_points") < LEAST_POINTS) & (F.col("_open") == 0), "under_load")
    loads = terms.withColumn("_load", load).where("_load is not null")
    kinds = {c: plan.schema[c].dataType for c in (place, course)}
    loads = issues(loads.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}), F.col("_load"), "warning")
    out = duplicate
    for part in (unknown, equivalent, needed, corequisite, advisory, loads):
        out = out.unionByName(part)
    return out
