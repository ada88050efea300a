"""Payloads and transcripts with nulls, malformed rows, repeats and empty tables."""

from lumenforge.sources import payloads, transcripts
from lumenforge.streaming import readings


def test_malformed_payloads_give_no_rows(spark):
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]"), (5, '{"reviews": 3}'), (6, '{"reviews": [null, {"content": "x"}]}')], "k int, body string")
    assert payloads.review_records(bad, "body").count() == 0
    assert payloads.link_records(bad, "body", ["x"]).count() == 0
    assert payloads.search_headers(bad, "body", "course").count() == 0
    assert payloads.captured_sections(bad, "body", "k").count() == 0


def test_reviews_and_headers(spark):
    one = '{"number_of_reviews": 9, "reviews": [{"review_id": 1, "content": "good", "rating": 6, "submission_date": "soon"}, {"review_id": 2, "content": "fine", "rating": 4, "submission_date": "2024-03-01T10:00:00+02:00"}]}'
    got = {r.review_id: r for r in payloads.review_records(spark.createDataFrame([(one,)], "body string"), "body").collect()}
    assert got[1].rating is None and got[1].posted_at is None and got[1].instructor_name is None
    assert got[2].rating == 4 and got[2].total_reviews == 9 and got[2].posted_at.hour == 8
    heads = spark.createDataFrame([('[{"course_header": {"course_code": "A", "course_name": "B"}}, {"professor_header": null}]',)], "body string")
    assert [tuple(r) for r in payloads.search_headers(heads, "body", "course").collect()] == [("A", "B")]


def test_transcript_lines(spark):
    text = "2024 spring Term\nCOMS W3134 Data Structures 3.00 points A-\nSPRING 2024 AWARDED 2019\nFall 2024 MATH UN1101 Calculus  B  Taken\nCOMS W3134 again F\nAPMA 2000 Transfer credit\nCHEM W1403 - Planned\n"
    got = {r.course_id: r for r in transcripts.candidates(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()}
    assert set(got) == {"COMS3134W", "MATH1101UN", "CHEM1403W"}
    assert (got["COMS3134W"].term, got["COMS3134W"].grade, got["COMS3134W"].points, got["COMS3134W"].warnings) == ("Spring 2024", "A-", 3.0, [])
    assert (got["MATH1101UN"].term, got["MATH1101UN"].grade) == ("Fall 2024", "B")
    assert got["CHEM1403W"].warnings == ["in_progress"]


def test_streams_over_several_batches(spark, tmp_path):
    rows = [(1, 10, 0, "a"), (1, 20, 1, "b"), (1, 20, 1, "c"), (2, 5, 1, "d"), (1, 30, 0, None), (1, 40, 1, "e"), (None, 1, 1, "f"), (2, 7, 0, "g"), (2, 9, 1, "h")]
    df = spark.createDataFrame([(k, s, bool(o), x) for k, s, o, x in rows], "k int, s int, o boolean, x string").selectExpr("k", "timestamp_seconds(s) as ts", "o", "x")
    schema = df.schema
    for i, part in enumerate((["a", "b", "c", "d"], ["e", "f", "g"], ["h"])):
        df.where(df.x.isin(part)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")

    def follow():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")

    got = readings.drain(readings.opened(follow(), "k", "ts", "x", "o"), "test-opened")
    assert sorted(r.x for r in got.collect()) == ["b", "h"]
    watched = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    last = readings.drain(readings.watched_latest(follow(), watched, "k", "ts", "x"), "test-watched", "complete").collect()
    assert [(r.k, r.x) for r in last] == [(2, "h")]


def test_course_codes(spark):
    from pyspark.sql import functions as F

    codes = {"MATH UN1201": "MATH1201UN", "COMS4115W": "COMS4115W", "COMSW3157": "COMS3157W", "MATHUN1201": "MATH1201UN", "ECON3213": "ECON3213", "PE 1001": "PE__1001", "AWARDED 2019": None, "ABCDEFGHIJ1000": None, None: None}
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", transcripts.course_code(F.col("c"))["course_id"].alias("id")).collect()
    assert {r.c: r.id for r in got} == codes


def test_html_tables_with_odd_pages(spark):
    from lumenforge.sources import html_tables

    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<tr><td>a<td>b &lt;c&gt;<tr><th>a</th><td>later"), (4, "<table><tr></table>")], "k int, html string")
    assert {r.k: r.fields for r in html_tables.labelled_fields(pages, "k", "html").collect()} == {3: {"a": "b <c>"}}
    assert html_tables.section_details(pages, "k", "html").count() == 0
    assert html_tables.subject_index(pages, "html").count() == 0


def test_pages_of_one_file_are_dealt_to_all_cores(spark):
    """Customers and orders fit one split of a file for long: their pages were laid out and read by one task."""
    from lumenforge.plans import catalog

    for name in ("s11_section_details", "s14_milestones", "s14_term_bounds"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan, name
