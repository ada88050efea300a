"""Exclusion keys, second passes and greedy plans against plain recomputation."""

import itertools

from pyspark.sql import functions as F

from lumenforge.operators import audits
from lumenforge.operators import prerequisites as pre


def test_second_pass_and_keys(spark):
    taken = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "c"), (None, "a"), ("r", None)], "person string, course string")
    members = spark.createDataFrame([(1, "x", "a"), (1, "y", "a"), (1, "y", "b"), (1, "z", "c")], "program int, grp string, course string")
    needs = spark.createDataFrame([(1, g, n) for g, n in (("x", 1), ("y", 2), ("z", 1))], "program int, grp string, need int")
    bars = spark.createDataFrame([(1, "y", "x"), (1, "y", "x"), (1, "y", "y"), (1, "z", "gone")], "program int, grp string, other string")
    got = {(r.person, r.grp): (r.matched, r.spent, r.status) for r in audits.audit(taken, members, needs, bars, "person").collect() if r.person}
    assert got == {("p", "x"): (1, 0, "met"), ("p", "y"): (1, 1, "partial"), ("q", "z"): (1, 0, "met")}
    keys = audits.exclusion_keys(needs, bars).collect()
    assert sorted(map(tuple, keys)) == [(1, "x", "1:x"), (1, "y", "1:x")]
    assert audits.audit(taken.limit(0), members, needs, bars, "person").count() == 0


def _greedy(courses, after, held, terms=3, limit=6):
    left, rows = dict(courses), []
    for term in range(1, terms + 1):
        points, now = 0, []
        while True:
            ready = [c for c, (p, _, _) in left.items() if after.get(c, set()) <= held and points + p <= limit]
            if not ready:
                break
            c = min(ready, key=lambda c: (-left[c][2], left[c][1], c))
            points += left.pop(c)[0]
            now.append(c)
            rows.append((c, term, len(now)))
        held |= set(now)
    return sorted(rows + [(c, None, None) for c in left], key=str)


def test_greedy_plans(spark):
    names = [f"COMS{1000 + i}W" for i in range(12)]
    courses = {c: (1 + i % 3, i // 4, (i * 7) % 5) for i, c in enumerate(names)}
    after = {c: {names[i - 4]} | ({names[i - 5]} if i % 2 and i > 4 else set()) for i, c in enumerate(names) if i >= 4}
    texts = spark.createDataFrame([(c, " and ".join(f"COMS W{x[4:8]}" for x in sorted(after.get(c, [])))) for c in names], "course string, text string")
    parsed = pre.parse(texts, "text", F.lit("COMS"))
    facts = spark.createDataFrame([(c, float(p), d, f) for c, (p, d, f) in courses.items()], "course string, points double, depth int, fan_out int")
    done = [[], names[:3], None]
    people = spark.createDataFrame(list(enumerate(done)), "person long, completed array<string>")
    wanted = facts.join(parsed, "course").crossJoin(people)
    got = audits.suggest_plan(wanted, "person", terms=3, points_per_term=6).collect()
    for person, rows in itertools.groupby(sorted(got, key=lambda r: r.person), key=lambda r: r.person):
        held = set(done[person] or [])
        want = _greedy({c: v for c, v in courses.items() if c not in held}, after, held)
        assert sorted(((r.course, r.term, r.place) for r in rows), key=str) == want
    assert audits.suggest_plan(wanted.limit(0), "person").count() == 0


def test_plans_carry_trees_as_strings_and_completed_by_table(spark):
    """Trees reach a person's courses as strings, and what people completed once a person; the plans are those of rows that carry all."""
    texts = spark.createDataFrame([("a", None), ("b", "COMS W1001 or COMS W1002"), ("c", "(COMS W1001 or COMS W1002) and COMS W1003"), ("d", "COMS W1001 and knowledge of Java")], "course string, text string")
    facts = pre.parse(texts, "text", F.lit("COMS")).selectExpr("*", "3.0 as points", "1 as depth", "if(course = 'a', null, 2) as fan_out")
    people = spark.createDataFrame([(1, ["COMS1001W"]), (2, ["COMS1002W", "COMS1003W"]), (3, None), (None, ["COMS1003W"])], "person long, completed array<string>")
    wanted = facts.crossJoin(people)
    packed = wanted.select("person", "course", "points", "depth", "fan_out", audits.packed_tree(F.col("nodes")).alias("tree"))
    whole = sorted(map(tuple, audits.suggest_plan(wanted, "person", terms=2, points_per_term=6).collect()), key=str)
    assert sorted(map(tuple, audits.suggest_plan(packed, "person", terms=2, points_per_term=6, completed=people.where("person is not null")).collect()), key=str) == whole
    assert (1, "b", 1, 1) in whole and (1, "c", None, None) in whole and (2, "c", 1, 2) in whole and (3, "a", 1, 1) in whole


def test_plans_read_parts_once(spark):
    """Trees were joined to the parts they came from, and for that sent through the driver."""
    from lumenforge.plans import catalog

    plan = catalog.QUERIES["g23_suggested_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [p_partkey") == 1
