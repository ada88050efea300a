"""Times, dates, places and terms in the forms that pages use."""

import pytest
from pyspark.sql import functions as F

from lumenforge.functions import dates
from lumenforge.sources import calendars


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", column(F.col("x")).alias("v")).collect()
    return [tuple(r.v) if isinstance(r.v, tuple) else r.v for r in sorted(rows)]


def test_clock_minutes(spark):
    texts = ["7:40pm", "7:40P", "12:05 am", "12 PM", "9", "9 A.M.", "19:40", "1940", "940", "25:00", "7:75", "13:00pm", "0:30am", "2460", "", None, "noon", " 8:00  AM "]
    assert values(spark, texts, dates.clock_minute) == [1180, 1180, 5, 720, None, 540, 1180, 1180, 580, None, None, None, None, None, None, None, None, 480]


def test_time_ranges(spark):
    texts = ["7:00pm - 9:30pm", "10:10am-11:25am", "7:10P - 8:25P", "1010 1240", "9 - 10:15am", "1 – 2:30pm", "9:00 to 10am", "9am", "x - 10am", "", None]
    assert values(spark, texts, dates.time_range) == [(1140, 1290), (610, 685), (1150, 1225), (610, 760), (540, 615), (780, 870), (540, 600), None, None, None, None]


def test_locations(spark):
    texts = ["142 Uris Hall", "963B Ext Hall", "Room TBA", "to be announced", "None None", "Great Hall", "", None]
    assert values(spark, texts, dates.location) == [("Uris Hall", "142"), ("Ext Hall", "963B"), (None, None), (None, None), (None, None), ("Great Hall", None), (None, None), (None, None)]


def test_course_numbers_and_terms(spark):
    assert values(spark, ["W1002", "bc 1014", "1002W", "4113", "x", None], dates.course_number) == [(1002, "W"), (1014, "BC"), (1002, "W"), (4113, None), None, None]
    texts = ["Fall 2026", "Autumn Term 2026", "2026 Spring", "Late Summer Dates related to the Fall 2026 term", "Summer dates, 2027", "Fall", "", None]
    assert values(spark, texts, dates.term_code) == ["20263", "20263", "20261", "20263", "20272", None, None, None]
    months = spark.createDataFrame([("20271", 11), ("20271", 2), ("20263", 9), ("20263", 1), ("20262", 5), ("20262", 9)], "t string, m int")
    assert [r[0] for r in months.select(dates.calendar_year(F.col("t"), F.col("m"))).collect()] == [2026, 2027, 2026, 2027, 2026, 2026]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_wall_clocks_in_the_hours_that_clocks_change(spark, zone):
    """The skipped hour takes summer's offset, the repeated one its first; the session's zone does not matter."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(2024, 3, 10, 1, 59), (2024, 3, 10, 2, 30), (2024, 3, 10, 3, 0), (2024, 11, 3, 0, 59), (2024, 11, 3, 1, 30), (2024, 11, 3, 2, 0), (2024, 7, 1, 0, 0), (2024, 12, 31, 23, 59)]
        df = spark.createDataFrame(rows, "y int, m int, d int, h int, n int")
        got = [r[0] for r in df.select(dates.wall_clock(*(F.col(c) for c in "ymdhn"), F.lit(0))).collect()]
        assert [g[-6:] for g in got] == ["-05:00", "-04:00", "-04:00", "-04:00", "-04:00", "-05:00", "-04:00", "-05:00"]
        assert got[1] == "2024-03-10T02:30:00-04:00"
        there = df.limit(1).select(dates.wall_clock(*(F.col(c) for c in "ymdhn"), F.lit(7), zone="Asia/Kolkata")).first()[0]
        assert there == "2024-03-10T01:59:07+05:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_calendar_ranges(spark):
    texts = ["October 27 - November 7, 2026", "October 27-31", "Oct 27 – Nov 7", "December 20 through Jan. 5", "Sept 3", "Sep 3, 2025", "Foo 3", "May 40", "soon", "", None]
    got = values(spark, texts, lambda x: dates.calendar_range(x, F.lit(2024)))
    short = [g and tuple(x and x[:10] for x in g) for g in got]
    assert short == [("2026-10-27", "2026-11-07"), ("2024-10-27", "2024-10-31"), ("2024-10-27", "2024-11-07"), ("2024-12-20", "2025-01-05"), ("2024-09-03", None), ("2025-09-03", None), None, None, None, None, None]
    assert got[2] == ("2024-10-27T00:00:00-04:00", "2024-11-07T23:59:59-05:00")


def test_calendars(spark):
    page = (
        "<h1>Spring 2027</h1><table><tr><td>January 19</td><td>First day of classes</td></tr><tr><td>Nov 16 - Nov 20, 2026</td><td>Appointments for seniors</td></tr>"
        "<tr><td>May 3, 2027</td><td>Last day of classes. Last day to change grades for Fall 2026</td></tr><tr><td>x</td></tr></table><h3>Notes</h3><dl><dt>May 1, 2027</dt><dd>Registration for Fall 2027 opens</dd></dl>"
    )
    pages = spark.createDataFrame([(1, page), (2, "<table><tr><td>May 1</td><td>Classes begin</td></tr></table>"), (3, None), (4, "")], "id long, html string")
    found = calendars.milestones(calendars.calendar_rows(pages, "id", "html"), "id")
    assert sorted((r.id, r.term, r.kind, r.starts_at[:10]) for r in found.collect()) == [(1, "20271", "add_drop_deadline", "2027-05-03"), (1, "20271", "appointment_window", "2026-11-16"), (1, "20271", "term_start", "2026-01-19"), (1, "20273", "registration_open", "2027-05-01")]
    assert {tuple(r) for r in calendars.term_bounds(found).collect()} == {("20271", "2026-01-19", "2027-05-03"), ("20273", None, None)}
