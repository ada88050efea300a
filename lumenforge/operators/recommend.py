"""Recommendations: candidates behind a hard gate of prerequisites, scored by requirements, taste, what they unlock and what was turned down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.operators import prerequisites as pre
from lumenforge.operators.graph import checkpointed
from lumenforge.operators.lsa import normalised

#: Weights of a score's parts, of courses that were liked, disliked or neither, and what a reason asks for; fixed values.
WEIGHTS = {"requirement": 1.0, "taste": 0.5, "unlock": 0.3, "offering": 0.2, "rejection": 0.6}
LOVED, NEUTRAL, DISLIKED = 3.0, 1.0, 0.25
TASTE_REASON, UNLOCK_REASON, NAMED = 0.15, 2, 3
#: Vectors of this many components in all, 16 MB as doubles, go to every task.
BROADCAST_COMPONENTS = 1 << 21


def _handy(vectors: DataFrame) -> DataFrame:
    """``vectors``, broadcast where they are small, so that rows that meet them need not carry them through shuffles."""
    n = vectors.agg(F.sum(F.size("vec"))).first()[0] or 0
    return F.broadcast(vectors) if n <= BROADCAST_COMPONENTS else vectors


def _dot(a: Column, b: Column) -> Column:
    """The cosine of unit vectors, so that a pair costs one sum of products; 0 for vectors of different sizes and zero vectors."""
    return F.coalesce(F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)), F.lit(0.0))


def _parts(df: DataFrame) -> int:
    """Into how many parts rows are dealt by person."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def taste_vectors(taken: DataFrame, vectors: DataFrame, person: str, course: str, liked: str = "liked") -> DataFrame:
    """(person, taste): the unit vector of the weighted mean of what a person took; people whose courses have no vectors give no row.

    ``taken`` has (person, course, liked), ``liked`` null for neither; ``vectors`` (course, vec) of one length. Sums are made by component, so no
    person's list of vectors is gathered.
    """
    weight = F.when(F.col(liked), LOVED).when(~F.col(liked), DISLIKED).otherwise(NEUTRAL)
    own = taken.select(person, course, weight.alias("_w")).repartition(_parts(taken), person)  # dealt before vectors are unfolded: where these are broadcast, sums need no shuffle
    parts = own.join(vectors, course).select(person, "_w", F.posexplode("vec").alias("_i", "_x"))
    sums = parts.groupBy(person, "_i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_v"))
    whole = sums.groupBy(person).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
    return whole.select(person, normalised(F.col("_p._v")).alias("taste"))


def credited_groups(outstanding: DataFrame, person: str, course: str) -> DataFrame:
    """Rows of ``outstanding`` (person, course, grp, place, cluster) that count: of a course's groups in one exclusion cluster the first by ``place``.

    Groups without a cluster all count. Another course of the same cluster is credited on its own.
    """
    w = Window.partitionBy(person, course, "cluster").orderBy("place", "grp")
    rows = outstanding.dropDuplicates([person, course, "grp"])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("cluster").isNull() | (F.col("_n") == 1)).drop("_n")


def _similar(ask: DataFrame, taken: DataFrame, vectors: DataFrame, person: str, course: str) -> DataFrame:
    """(person, course, similar): up to NAMED courses that a person took and that are nearest to a candidate, of those on its side; vectors of length one."""
    own = taken.select(person, F.col(course).alias("_t")).distinct()
    pairs = ask.repartition(_parts(ask), person).join(own.hint("merge"), person).join(vectors, course).join(vectors.select(F.col(course).alias("_t"), F.col("vec").alias("_tv")), "_t")
    near = pairs.withColumn("_s", _dot(F.col("vec"), F.col("_tv"))).where("_s > 0")
    w = Window.partitionBy(person, course).orderBy(F.desc("_s"), "_t")
    top = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= NAMED)
    return top.groupBy(person, course).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_l")).select(person, course, F.col("_l._t").alias("similar"))


def gated(ask: DataFrame, parsed: DataFrame, completed: DataFrame, person: str, item: str, course: str, max_depth: int = 6, shapes: bool = True) -> DataFrame:
    """``ask`` (person, item) with status, missing (open choices), advisories and withheld.

    Withheld is what is surely unmet, and what is unknown only because a permission softened it: there a choice is still open. What is unknown
    with nothing open stays. By ``shapes`` of trees, which a job finds at once, or pair by pair without one.
    """
    if shapes:
        done = pre.judged(ask, parsed, completed, person, item, course, max_depth)
    else:
        done = pre.gate(pre.evaluate(ask, pre.nodes(parsed, item), completed, person, item, course, max_depth), parsed, item)
    told = parsed.select(item, F.coalesce("advisories", F.array().cast("array<string>")).alias("advisories"))
    out = done.withColumnRenamed("outstanding", "missing").join(told, item, "left")
    held = (F.col("status") == pre.UNMET) | ((F.col("status") == pre.UNKNOWN) & (F.size("missing") > 0))
    return out.withColumn("withheld", held)


def _judged(candidates: DataFrame, taken: DataFrame, planned: DataFrame, rejected: DataFrame, parsed: DataFrame, person: str, course: str, max_depth: int, shapes: bool = True) -> tuple[DataFrame, DataFrame]:
    """(completed, state): taken and planned courses, and the candidates beyond them and rejected ones as ``gated`` judges them."""
    pair = [person, course]
    completed = taken.select(*pair).unionByName(planned.select(*pair)).distinct()
    ask = candidates.select(*pair).distinct().join(completed, pair, "left_anti").join(rejected.select(*pair), pair, "left_anti")
    return completed, gated(ask, parsed, completed.withColumnRenamed(course, "_done"), person, course, "_done", max_depth, shapes)


def _withheld(state: DataFrame, person: str, course: str, limit: int) -> DataFrame:
    held = state.where("withheld").withColumn("reason", F.when(F.col("status") == pre.UNKNOWN, "prereq_unmet_but_permission").otherwise("prereq_unmet"))
    w = Window.partitionBy(person).orderBy(F.col("reason") != "prereq_unmet_but_permission", course)
    return held.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(person, course, "place", "reason", "missing", "advisories")


def held_back(candidates: DataFrame, taken: DataFrame, planned: DataFrame, rejected: DataFrame, parsed: DataFrame, person: str, course: str, limit: int, max_depth: int = 6) -> DataFrame:
    """The withheld rows of ``recommend`` alone, without a score for anything that passes the gate."""
    return _withheld(_judged(candidates, taken, planned, rejected, parsed, person, course, max_depth, shapes=False)[1], person, course, limit)


def recommend(
    candidates: DataFrame,
    taken: DataFrame,
    planned: DataFrame,
    rejected: DataFrame,
    vectors: DataFrame,
    outstanding: DataFrame,
    parsed: DataFrame,
    person: str,
    course: str,
    limit: int,
    withheld_limit: int,
    max_depth: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """(recommended, withheld) for every person of ``candidates`` (person, course).

    ``taken`` has (person, course, liked), ``planned`` and ``rejected`` (person, course), ``vectors`` (course, vec), ``outstanding`` (person, course, grp,
    place, cluster), ``parsed`` is what ``prerequisites.parse`` gives, by ``course``. Taken and planned courses count as completed; they and
    rejected ones are no candidates. Recommended rows have place, score and its parts, groups, unlocked, similar, reasons and caveats; withheld rows
    reason and missing. A person's candidates stay rows throughout; only a person's own courses meet them.
    """
    pair = [person, course]
    completed, state = _judged(candidates, taken, planned, rejected, parsed, person, course, max_depth)
    state = checkpointed(state)
    withheld = _withheld(state, person, course, withheld_limit)

    taste = taste_vectors(taken, _handy(vectors.select(course, "vec")), person, course)
    vectors = _handy(vectors.select(course, normalised(F.col("vec")).alias("vec")))
    rows = state.where("not withheld").join(taste, person, "left").join(vectors, course, "left")
    rows = rows.withColumn("taste_similarity", F.when(F.col("vec").isNotNull() & F.col("taste").isNotNull(), _dot(F.col("vec"), F.col("taste"))).otherwise(0.0))
    rows = checkpointed(rows.withColumn("_seen", F.col("vec").isNotNull()).drop("vec", "taste"))  # vectors are joined again where they are used
    # candidates meet refused courses by name, and vectors only then: none travels with a person's rows, and what is summed by candidate lies together
    seen = rows.where("_seen").select(*pair).repartition(_parts(rows), person)
    met = seen.join(rejected.select(person, F.col(course).alias("_r")).distinct().hint("merge"), person).join(vectors, course).join(vectors.select(F.col(course).alias("_r"), F.col("vec").alias("_rv")), "_r")
    away = met.groupBy(*pair).agg(F.greatest(F.lit(0.0), F.max(_dot(F.col("vec"), F.col("_rv")))).alias("rejection"))
    groups = credited_groups(outstanding, person, course).groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("place", "grp"))).alias("_g"))
    unlocked = pre.newly_unlocked(rows.select(person, F.col(course).alias("added")), parsed.withColumnRenamed(course, "_item"), completed.withColumnRenamed(course, "_done"), person, "_item", "_done", max_depth)
    opened = unlocked.groupBy(person, F.col("added").alias(course)).agg(F.array_sort(F.collect_set("_item")).alias("unlocked"))
    similar = _similar(rows.where(F.col("_seen") & (F.col("taste_similarity") >= TASTE_REASON)).select(*pair), taken, vectors, person, course)
    kind = taken.schema[course].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    some = taken.select(person).distinct().withColumn("_some", F.lit(True))
    full = rows.join(away, pair, "left").join(groups, pair, "left").join(opened, pair, "left").join(similar, pair, "left").join(some, person, "left")
    full = full.withColumns({"rejection": F.coalesce("rejection", F.lit(0.0)), "groups": F.coalesce(F.col("_g.grp"), F.array().cast(f"array<{outstanding.schema['grp'].dataType.simpleString()}>")), "unlocked": F.coalesce("unlocked", none), "similar": F.coalesce("similar", none)})
    parts = {
        "requirement_fit": WEIGHTS["requirement"] * F.size("groups"),
        "taste_fit": WEIGHTS["taste"] * F.col("taste_similarity"),
        "unlock_fit": WEIGHTS["unlock"] * F.log1p(F.size("unlocked")),
    }
    scored = full.withColumns(parts).withColumn("score", F.col("requirement_fit") + F.col("taste_fit") + F.col("unlock_fit") - WEIGHTS["rejection"] * F.col("rejection"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy(person).orderBy(F.desc("score"), course))).where(F.col("place") <= limit)
    return best.withColumns({"reasons": _reasons(), "caveats": _caveats()}).select(*pair, "place", "score", *parts, "rejection", "groups", "unlocked", "similar", "reasons", "caveats"), withheld


def _reasons() -> Column:
    """What speaks for a course: a group it counts for (and is of interest for), else what it is like, and what it opens up, for people with a record."""
    alike = F.size("similar") > 0
    counts = F.transform("groups", lambda g: F.concat(F.when(alike, "interesting_and_counts:").otherwise("required:"), g.cast("string")))
    like = F.when(alike & (F.size("groups") == 0), F.array(F.lit("because_you_took"))).otherwise(F.array().cast("array<string>"))
    opens = F.when(F.col("_some") & (F.size("unlocked") >= UNLOCK_REASON), F.array(F.concat(F.lit("unlocks:"), F.size("unlocked").cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.concat(counts, like, opens)


def _caveats() -> Column:
    return F.array_compact(F.array(F.when(F.col("status") == pre.UNKNOWN, "prereq_unknown"), F.when(~F.col("_seen"), "no_vector")))
