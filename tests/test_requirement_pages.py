"""Requirement pages with their odd shapes: "or" rows, sequences, counts, notes, sections, areas without courses, nulls and empty pages."""

from pyspark.sql import functions as F

from lumenforge.operators import rules
from lumenforge.sources import html_tables
from lumenforge.sources import requirement_tables as tables


def area(text):
    return f'<tr><td><span class="courselistcomment areaheader">{text}</span></td></tr>'


def note(text):
    return f"<tr><td colspan=2><span class='courselistcomment'>{text}</span></td></tr>"


def course(code):
    return f'<tr class="odd"><td class="codecol"><a title="x">{code}</a></td><td>Title</td><td class="hourscol">3</td></tr>'


def listed(*rows):
    return f'<table class="sc_courselist wide"><tbody>{"".join(rows)}</tbody></table>'


def parse(spark, *pages, **kw):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return tables.areas(df, "id", "html", **kw)


def test_kinds_and_labels(spark):
    page = "<h2>Major in Things</h2>" + listed(
        course("COMS W1004"), course("or COMS W1007"),
        area("Core Requirement (12-15 points)"), course("COMS W3134"), note("Take  early"), course("COMS W3157"), note("Ask &amp; see"),
        area("Calculus Requirement: Select one of the following sequences:"), course("MATH UN1101&amp; MATH UN1102"), course("MATH UN1207 and MATH UN1208"),
        area("Electives: Select at least three of the following"), course("COMS W4111"), course("or COMS W4112"), course("not a code"),
        area("Choose a course"), course("COMS W4701"),
        area("Choose 2"), course("COMS W4995"),
        area("Together"), course("PHYS UN1401&amp; PHYS UN1402"),
        area("Pointers"), note("All core courses"),
    )
    got = {r.area_no: r for r in parse(spark, page).collect()}
    assert [(got[i].label, got[i].kind, got[i].need) for i in sorted(got)] == [
        ("Major in Things", "n_of", 1), ("Core", "all_of", None), ("Calculus", "sequence_choice", None), ("Electives", "n_of", 3), ("Choose a course", "n_of", 1), ("Choose 2", "n_of", 2), ("Together", "all_of", None), ("Pointers", None, None),
    ]
    assert got[1].options == [["COMS W1004"], ["COMS W1007"]] and got[1].header == "Major in Things Select one of the following:"
    assert got[2].note == "Take early Ask & see" and got[3].options == [["MATH UN1101", "MATH UN1102"], ["MATH UN1207", "MATH UN1208"]]
    assert got[4].options == [["COMS W4111"], ["COMS W4112"]]
    found = parse(spark, page)
    assert [tuple(r) for r in tables.unresolved(found, "id").collect()] == [(0, 8, "Major in Things", "Pointers", "Pointers All core courses")]


def test_odd_pages(spark):
    first_or = "<h3>A</h3>" + listed(course("or COMS W1000"), course("COMS W1010"))
    renamed = "<h2>B</h2>" + listed(course("COMS W1004")) + "<h2> </h2>" + listed(course("COMS W1007")) + "<table><tr><td class='codecol'>COMS W1009</td></tr></table>"
    unclosed = '<!-- <h2>old</h2> --><table class="sc_courselist"><tr><td class=codecol>PE 1001<tr><td class="codecol">ECON UN1105'
    got = [(r.id, r.label, r.kind, r.options) for r in parse(spark, None, "", "<p>x</p>", first_or, renamed, unclosed, "<h2>E</h2>" + listed(), listed()).orderBy("id", "area_no").collect()]
    assert got == [
        (3, "A", "all_of", [["COMS W1000"], ["COMS W1010"]]), (4, "B", "all_of", [["COMS W1004"]]), (4, "Requirement", "all_of", [["COMS W1007"]]),
        (5, "Requirement", "all_of", [["PE 1001"], ["ECON UN1105"]]), (6, "E", None, []),
    ]
    assert parse(spark, "x").where("false").count() == 0


def test_sections_and_ids(spark):
    page = "".join(f"<h2>{h}</h2>" + listed(course(c)) for h, c in (("Minor", "COMS W1001"), ("MAJOR in X", "COMS W1002"), ("Core!", "COMS W1003"), ("core", "COMS W1004"), ("Faculty", "COMS W1005")))
    found = parse(spark, page, section="major", stop_at=["faculty"])
    got = tables.groups(found, "id").orderBy("group_no").collect()
    assert [(r.group_no, r.group_id, r.options) for r in got] == [(0, "major-in-x", [["COMS W1002"]]), (1, "core", [["COMS W1003"]]), (2, "core-2", [["COMS W1004"]])]


def test_parsed_rules_give_an_audit(spark):
    page = "<h2>Core</h2>" + listed(course("COMS W1004"), course("or COMS W1007"), area("Select one of the following sequences:"), course("MATH UN1101&amp; MATH UN1102"), course("MATH UN1207&amp; MATH UN1208"))
    groups, wanted = tables.as_rules(parse(spark, page), "id")
    people = spark.createDataFrame([("a", 0), ("b", 0)], "who string, program int")
    taken = spark.createDataFrame([("a", "COMS1007W", False, 3.0), ("a", "MATH1208UN", False, 3.0), ("b", "MATH1101UN", True, 3.0), ("b", "MATH1102UN", False, 3.0)], "who string, course string, planned boolean, points double")
    none = wanted.select("program", "grp", "course").where("false")
    said = people.select("who", "program", F.lit(0).cast("long").alias("grp")).where("false")
    got = {(r.who, r.grp): (r.completed, r.required, r.status) for r in rules.evaluate(people, taken, groups, wanted, none, said, "who").collect()}
    assert got == {("a", 1): (1, 1, "satisfied"), ("a", 2): (1, 2, "in_progress"), ("b", 1): (0, 1, "unmet"), ("b", 2): (2, 2, "satisfied")}


def test_names_keep_their_letters(spark):
    page = "<table><tr><td>Section key</td><td>20263COMS4115W001</td></tr><tr><td>Instructors</td><td>0tto Lee0, 1da Ray1 and Bo Li2</td></tr></table>"
    got = html_tables.section_details(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").first()
    assert got.instructors == ["0tto Lee0", "1da Ray1", "Bo Li2"]


def test_patterns_are_not_worked_out_again_in_filters(spark):
    """Filters on marks, texts and kinds were pushed below their columns, with all the patterns that make them."""
    from lumenforge.plans import catalog

    plan = catalog.QUERIES["s16_requirement_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("filter ")]
    assert filters and not any("rlike" in f or "regexp" in f for f in filters)


def test_rules_are_read_from_pages_once(spark):
    """Every use of the groups and of what they ask for read all pages again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    pages = spark.createDataFrame([(i, "<h2>Core</h2>" + listed(course("COMS W1004"), course("COMS W1007"))) for i in range(3)], "id long, html string")
    groups, wanted = tables.as_rules(tables.areas(pages.mapInPandas(counted, pages.schema), "id", "html"), "id")
    assert groups.count() == 3 and wanted.count() == 6 and wanted.join(groups, ["program", "grp"]).count() == 6
    assert read.value == 3
