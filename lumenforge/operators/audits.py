"""Requirement groups over taken courses, with groups that may not share a course, and greedy plans by term."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.operators.graph import min_label_components


def audit(taken: DataFrame, members: DataFrame, needs: DataFrame, exclusions: DataFrame, person: str) -> DataFrame:
    """(person, program, grp, matched, spent, status) of every person and group with a match in the first pass.

    ``taken`` (person, course), ``members`` (program, grp, course), ``needs`` (program, grp, need), ``exclusions`` (program, grp, other).
    A first pass matches each group on its own; then a group that excludes others loses the courses that these matched in the first
    pass. Status: met, partial, or unmet when nothing is left. Repeats count once; nulls match nothing.
    """
    first = taken.select(person, "course").distinct().join(members.select("program", "grp", "course").distinct(), "course")
    bars = exclusions.select("program", "grp", F.col("other")).where("grp <> other").distinct()
    used = first.select(person, "program", F.col("grp").alias("other"), "course")
    spent = used.join(bars, ["program", "other"]).select(person, "program", "grp", "course").distinct().withColumn("_spent", F.lit(1))
    marked = first.join(spent, [person, "program", "grp", "course"], "left")
    counts = marked.groupBy(person, "program", "grp").agg(F.count_if(F.col("_spent").isNull()).alias("matched"), F.count("_spent").alias("spent"))
    status = F.when(F.col("matched") >= F.col("need"), "met").when(F.col("matched") > 0, "partial").otherwise("unmet")
    return counts.join(needs, ["program", "grp"]).select(person, "program", "grp", "matched", "spent", status.alias("status"))


def exclusion_keys(groups: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(program, grp, key): groups of a program that exclude one another, at any remove, share a key named after the smallest; others have none."""
    node = lambda c: F.to_json(F.struct("program", F.col(c).alias("grp")))
    known = groups.select("program", "grp").distinct()
    pairs = exclusions.where("grp <> other").join(known, ["program", "grp"]).join(known.select("program", F.col("grp").alias("other")), ["program", "other"])
    found = min_label_components(pairs.select(node("grp").alias("a"), node("other").alias("b")), "a", "b")
    shape = T.StructType([groups.schema["program"], groups.schema["grp"]])
    named = found.select(F.from_json("node", shape).alias("n"), F.from_json("component", shape).alias("c"))
    return named.select("n.program", "n.grp", F.concat_ws(":", "c.program", "c.grp").alias("key"))


def packed_tree(nodes: Column) -> Column:
    """A tree's nodes in reading order as one string, a line each: number, parent (empty at the root), first letter of the kind, value. Null stays null."""
    line = lambda n: F.concat(n["node"], F.lit("\t"), F.coalesce(n["parent"].cast("string"), F.lit("")), F.lit("\t"), F.left(n["kind"], F.lit(2)), F.lit("\t"), F.coalesce(n["value"], F.lit("")))
    return F.array_join(F.transform(nodes, line), "\n")


@lru_cache(maxsize=1 << 14)
def _unpacked(tree: str) -> list[tuple]:
    """(node, parent, kind, value) of a packed tree, children before their parents; values hold no line ends or tabs, as ``parse`` makes them."""
    return [tuple(line.split("\t", 3)) for line in reversed(tree.split("\n"))]


def _open(tree: str | None, held: set[str]) -> bool:
    """Whether a packed tree is not unmet; advisories never stand in the way."""
    good: dict[str, list[bool]] = {}
    for node, parent, kind, value in _unpacked(tree) if tree else []:
        kids = good.pop(node, [])
        ok = value in held if kind == "co" else True if kind == "ad" else all(kids) if kind == "al" else any(kids)
        if not parent:
            return ok
        good.setdefault(parent, []).append(ok)
    return True


def _plan(courses: list[tuple], held: set[str], terms: int, points_per_term: float) -> list[tuple]:
    """(course, term, place) of one person's courses (course, points, depth, fan_out, tree), those that fit nowhere at the end."""
    last = lambda v: (v is None, v or 0)
    once = {c[0]: c for c in reversed(courses) if c[0] not in held}
    order = sorted(once.values(), key=lambda c: (last(None if c[3] is None else -c[3]), last(c[2]), c[0]))
    left = {c[0]: (3.0 if c[1] is None or c[1] != c[1] else c[1], c[4]) for c in order}
    rows = []
    for term in range(1, terms + 1):
        points, chosen = 0.0, []
        for course, (cost, tree) in left.items():
            if points + cost <= points_per_term and _open(tree, held):
                points += cost
                chosen.append(course)
                rows.append((course, term, len(chosen)))
        held.update(chosen)
        for course in chosen:
            del left[course]
    return rows + [(course, None, None) for course in left]


def suggest_plan(wanted: DataFrame, person: str, terms: int = 8, points_per_term: float = 15.0, completed: DataFrame | None = None) -> DataFrame:
    """(person, course, term, place): a greedy plan; courses that fit nowhere have a null term and place.

    ``wanted`` has a row a person and course: (person, course, points, depth, fan_out, nodes, completed), or what ``packed_tree`` makes of the nodes as
    ``tree``; the courses a person has completed may also stand in a table ``completed`` (person, completed), so that rows need not carry them. In each
    term, while points last, the ready course with most fan-out, then least depth, then least name is taken; a course is ready when its tree is not
    unmet by what was completed before the term. Null points count 3. The choice depends on all choices before it, so a person's courses, a few
    dozen, are gathered in one row; a batch of Arrow holds many people.
    """
    tree = F.col("tree") if "tree" in wanted.columns else packed_tree(F.col("nodes"))
    parts = [F.collect_list(F.struct("course", F.col("points").cast("double").alias("points"), "depth", "fan_out", tree.alias("tree"))).alias("_w")]
    if completed is None:
        people = wanted.where(F.col("course").isNotNull()).groupBy(person).agg(*parts, F.flatten(F.collect_set("completed")).alias("_held"))
    else:
        gathered = wanted.where(F.col("course").isNotNull()).groupBy(person).agg(*parts)
        people = gathered.join(completed.select(person, F.col("completed").alias("_held")).hint("merge"), person, "left")
    kind = people.schema[person].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, courses, place, rows, at = b.column(0), b.column(1), [], [], 0
            fields = list(zip(*(f.to_pylist() for f in courses.flatten().flatten()), strict=True))
            for i, (n, held) in enumerate(zip(courses.value_lengths().to_pylist(), b.column(2).to_pylist(), strict=True)):
                got = _plan(fields[at : at + n], set(held or []), terms, points_per_term)
                at += n
                place += [i] * len(got)
                rows += got
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([who.take(pa.array(place, pa.int64())), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], [person, "course", "term", "place"])

    return people.select(person, "_w", "_held").mapInArrow(run, f"`{person}` {kind}, course string, term int, place int")
