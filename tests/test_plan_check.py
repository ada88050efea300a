"""Plans against a check that walks term by term with a growing set, recommendations on a small record."""

import random

import pytest

from lumenforge.operators import plan_check, recommend
from lumenforge.operators import prerequisites as pre

TEXTS = {
    "ART1": None,
    "ART2": "ART W0001.",
    "ART3": "(ART W0001 or ART W0002) and ART W0004",
    "ART4": "ART W0001 and ART W0099, or permission of the instructor.",
    "ART5": "Prerequisite: ART W0077. Corequisite: ART W0002 or ART W0003.",
    "ART6": "ART W0002 and knowledge of Java, as said",
    "ART7": "Some experience of drawing",
}


def tree_of(nodes, clause, done, at=None):
    """(status, open choices) of a parsed clause by plain recursion."""
    own = [n for n in nodes if n[0] == clause]
    if not own:
        return 2, []

    def value(n):
        if n[4] == "advisory":
            return 1, []
        if n[4] == "course":
            return (2, []) if n[5] in done else (0, [[n[5]]])
        kids = [value(c) for c in own if c[2] == n[1]]
        if n[4] == "all":
            s = min(k[0] for k in kids)
            return s, [o for k in kids if k[0] == 0 for o in k[1]] if s == 0 else []
        s = max(k[0] for k in kids)
        options = sorted({x for k in kids for o in k[1] for x in o})
        return s, [options] if s != 2 and options else []

    return value(next(n for n in own if n[2] is None))


def walked(plan, points, parsed, equivalents):
    """Issues of one plan: terms in order, a set of earlier courses that grows."""
    out, completed, placed = [], set(), {}
    for term in sorted({t for t, _, _ in plan}):
        row = sorted((p, c) for t, p, c in plan if t == term)
        concurrent, total, open_ = completed | {c for _, c in row}, 0, 0
        for place, c in row:
            add = lambda kind, severity, o=(), other=None, place=place, c=c: out.append((term, place, c, kind, severity, tuple(o), other))
            if c in placed:
                add("duplicate_course", "error")
            placed[c] = term
            if c not in points:
                add("unknown_course", "warning")
                continue
            open_ += points[c] is None
            total += points[c] or 0
            for e in sorted({e for x, e in equivalents if x == c and e in placed and e != c}):
                add("equivalent_conflict", "warning", other=e)
            got = parsed[c]
            if got is None:
                continue
            permission, _, advisories, nodes = got
            status, choices = tree_of(nodes, "before", completed)
            for o in {tuple(o) for o in choices} if status == 0 else ():
                if not any(x in points for x in o):
                    add("prereq_external", "warning", o)
                else:
                    add("prereq_unmet", "warning" if permission else "error", o)
            status, choices = tree_of(nodes, "beside", concurrent)
            for o in {tuple(o) for o in choices} if status == 0 else ():
                add("corequisite_unmet", "error", o)
            for a in advisories:
                add("prereq_unknown", "info", other=a)
        if total > 18 or total < 12 and not open_:
            out.append((term, None, None, "over_load" if total > 18 else "under_load", "warning", (), None))
        completed |= {c for _, c in row}
    return out


@pytest.fixture(scope="module")
def parsed(spark):
    return pre.parse(spark.createDataFrame(list(TEXTS.items()), "course string, text string"), "text", pre.F.lit("ART")).cache()


def test_plans_are_judged_as_term_by_term(spark, parsed):
    rng = random.Random(6)
    names = {f"ART{n}W": f"ART{n}" for n in (1, 2, 3, 4, 5, 6, 7)}
    coded = parsed.withColumn("course", pre.F.concat("course", pre.F.lit("W")))
    told = {c: pre._parse(TEXTS[names[c]], "ART") for c in names}
    points = {c: rng.choice([3, 4, 9, None]) for c in names}
    pool = [*names, "ART99W", "ART50W"]
    equivalents = [("ART1W", "ART2W"), ("ART2W", "ART1W"), ("ART3W", "ART99W")]
    rows, want = [], []
    for person in range(60):
        plan = [(t, p, rng.choice(pool)) for t in rng.sample(range(8), rng.randint(1, 5)) for p in range(rng.randint(1, 4))]
        rows += [(person, *x) for x in plan]
        want += [(person, *x) for x in walked(plan, points, told, equivalents)]
    plan = spark.createDataFrame([*rows, (None, 1, 1, "ART1W"), (1, None, 1, "ART1W"), (1, 1, 9, None)], "person long, term int, place int, course string").repartition(3)
    courses = spark.createDataFrame(list(points.items()), "course string, points int")
    pairs = spark.createDataFrame(equivalents, "course string, other string")
    got = plan_check.check_plans(plan, courses, coded, pairs, "person", "term", "place", "course").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((*r[:6], tuple(r.resolved_by), r.other) for r in got), key=key) == sorted(want, key=key)
    assert {r.kind for r in got} == {"duplicate_course", "unknown_course", "equivalent_conflict", "prereq_unmet", "prereq_external", "corequisite_unmet", "prereq_unknown", "over_load", "under_load"}
    assert plan_check.check_plans(plan.where("false"), courses, coded, pairs, "person", "term", "place", "course").count() == 0


def test_recommendations_of_a_small_record(spark, parsed):
    coded = parsed.withColumn("course", pre.F.concat("course", pre.F.lit("W")))
    frame = lambda rows, fields: spark.createDataFrame(rows, fields)
    everyone = [(p, f"ART{n}W") for p in (1, 2) for n in range(1, 8)]
    taken = frame([(1, "ART1W", True), (1, "ART7W", None)], "person long, course string, liked boolean")
    planned, none = frame([(1, "ART2W")], "person long, course string"), frame([], "person long, course string")
    rejected = frame([(1, "ART5W")], "person long, course string")
    vectors = frame([("ART1W", [1.0, 0.0]), ("ART6W", [0.8, 0.6]), ("ART3W", [-1.0, 0.0]), ("ART5W", [0.8, 0.6])], "course string, vec array<double>")
    outstanding = frame([(1, "ART6W", 1, 1, "x"), (1, "ART6W", 2, 2, "x"), (1, "ART6W", 3, 3, None), (1, "ART6W", 3, 3, None)], "person long, course string, grp long, place int, cluster string")
    best, held = recommend.recommend(frame(everyone, "person long, course string"), taken, planned, rejected, vectors, outstanding, coded, "person", "course", 10, 10)
    rows = {(r.person, r.course): r for r in best.collect()}
    withheld = {(r.person, r.course): (r.reason, r.missing) for r in held.collect()}
    assert {k for k in rows if k[0] == 1} == {(1, "ART6W")}  # the rest is taken, planned, turned down or held back
    six = rows[1, "ART6W"]
    assert six.groups == [1, 3] and six.similar == ["ART1W"] and six.reasons == ["interesting_and_counts:1", "interesting_and_counts:3"] and six.caveats == ["prereq_unknown"]
    assert abs(six.score - (2 + 0.5 * 0.8 - 0.6 * 1.0)) < 1e-9
    assert withheld[1, "ART3W"] == ("prereq_unmet", [["ART4W"]]) and withheld[1, "ART4W"] == ("prereq_unmet_but_permission", [["ART99W"]])
    guest = {c: r for (p, c), r in rows.items() if p == 2}
    assert set(guest) == {"ART1W", "ART7W"} and guest["ART1W"].reasons == [] and len(guest["ART1W"].unlocked) >= 2 and guest["ART7W"].caveats == ["prereq_unknown", "no_vector"]
    assert withheld[2, "ART2W"] == ("prereq_unmet", [["ART1W"]])
    empty, held = recommend.recommend(none, taken, planned, none, vectors, outstanding, coded, "person", "course", 10, 10)
    assert empty.count() == 0 and held.count() == 0


def test_rows_kept_between_steps_hold_no_vectors(spark, monkeypatch):
    """Candidates lie on disk without vectors; taste and likeness come out all the same."""
    kept, own = [], recommend.checkpointed
    monkeypatch.setattr(recommend, "checkpointed", lambda df: kept.append(df.columns) or own(df))
    parsed = pre.parse(spark.createDataFrame([("ART1W", None), ("ART2W", None), ("ART3W", "ART W0001.")], "course string, text string"), "text", pre.F.lit("ART"))
    pairs = lambda *rows: spark.createDataFrame(rows, "person long, course string")
    taken = spark.createDataFrame([(1, "ART1W", True)], "person long, course string, liked boolean")
    vectors = spark.createDataFrame([("ART1W", [1.0, 0.0]), ("ART3W", [3.0, 4.0])], "course string, vec array<double>")
    none = pairs((0, "x")).where("false")
    groups = spark.createDataFrame([], "person long, course string, grp long, place int, cluster string")
    best, _ = recommend.recommend(pairs((1, "ART2W"), (1, "ART3W")), taken, none, none, vectors, groups, parsed, "person", "course", 5, 5, max_depth=1)
    got = {r.course: (round(r.taste_fit, 6), r.similar, r.caveats) for r in best.collect()}
    assert got == {"ART3W": (0.3, ["ART1W"], []), "ART2W": (0.0, [], ["no_vector"])}
    assert kept and not any({"vec", "taste"} & set(columns) for columns in kept)


def test_withheld_courses_need_no_scores(spark):
    """What the gate holds back was found only after all that passes it was scored; building its query now runs no job."""
    from lumenforge.plans import catalog

    plan = catalog.QUERIES["g13_withheld"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_tastes_are_summed_without_moving_components(spark):
    """Every component of every taken course was shuffled, and candidates with their vectors to what was turned down."""
    taken = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "a", False)], "person long, course string, liked boolean")
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 1.0])], "course string, vec array<float>")
    got = recommend.taste_vectors(taken, pre.F.broadcast(vectors), "person", "course")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate")[0]
    tastes = {r.person: [round(x, 6) for x in r.taste] for r in got.collect()}
    assert tastes == {1: [round(9 / 82**0.5, 6), round(1 / 82**0.5, 6)], 2: [1.0, 0.0]}
