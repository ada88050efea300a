"""Times and dates as pages write them, and academic calendars (S14), on texts laid out from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.functions import dates
from lumenforge.plans.registry import query
from lumenforge.sources import calendars


@query("""
select event_id, case when event_id % 4 < 3 then hour(ts) * 60 + minute(ts) end::bigint as minute, case when event_id % 4 = 0 then hour(ts) * 60 + minute(ts) end::bigint as range_start from events
""")
def d_clock_minutes(spark, t):
    """Instants written in four ways, one of which says nothing, and read again."""
    h = F.date_format("ts", "h:mm")
    half = F.when(F.hour("ts") < 12, "am").otherwise("pm")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(h, half)).when(kind == 1, F.date_format("ts", "HHmm")).when(kind == 2, F.concat(h, F.lit("  "), F.when(half == "am", "A.M.").otherwise("p.m."))).otherwise("TBA")
    span = F.when(kind == 0, F.concat(h, half, F.lit(" to "), h, half))
    return t("events").select("event_id", dates.clock_minute(text).cast("long").alias("minute"), dates.time_range(span)["start"].cast("long").alias("range_start"))


@query("""
with d as (select o_orderkey, o_orderdate::date as d, (o_orderkey % 24)::bigint as h, (o_orderkey % 60)::bigint as m from orders),
c as (select *, make_date(year(d), 4, 1) + ((7 - dayofweek(make_date(year(d), 4, 1))) % 7)::int as spring, make_date(year(d), 10, 31) - dayofweek(make_date(year(d), 10, 31))::int as autumn from d)
select o_orderkey, strftime(d, '%Y-%m-%d') || 'T' || printf('%02d', h) || ':' || printf('%02d', m) || ':00' || case when (d > spring or d = spring and h >= 2) and (d < autumn or d = autumn and h < 2) then '-04:00' else '-05:00' end as at from c
""")
def d_wall_clocks(spark, t):
    """Local readings with the offset that the date and the hour have."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    return t("orders").select("o_orderkey", dates.wall_clock(F.year(d), F.month(d), F.day(d), (k % 24).cast("int"), (k % 60).cast("int"), F.lit(0)).alias("at"))


_YEAR = "2020 + c_custkey % 5"
_MILESTONES = f"""
select c_custkey, ({_YEAR}) || '3' as term, 'appointment_window' as kind, 'Appointment window & more' as label, ({_YEAR}) || '-12-' || (20 + c_custkey % 10) || 'T00:00:00-05:00' as starts_at, (1 + {_YEAR}) || '-01-0' || (1 + c_custkey % 9) || 'T23:59:59-05:00' as ends_at from customer
union all select c_custkey, ({_YEAR}) || '3', 'term_start', 'Classes begin', ({_YEAR}) || '-09-' || lpad((1 + c_custkey % 28)::varchar, 2, '0') || 'T00:00:00-04:00', null from customer
union all select c_custkey, ({_YEAR}) || '3', 'add_drop_deadline', 'Last day of classes; last day to drop', ({_YEAR}) || '-12-' || lpad((1 + c_custkey % 20)::varchar, 2, '0') || 'T00:00:00-05:00', null from customer
union all select c_custkey, (1 + {_YEAR}) || '1', 'registration_open', 'Registration for Spring ' || (1 + {_YEAR}) || ' opens', ({_YEAR}) || '-11-15T00:00:00-05:00', null from customer
"""


def _milestones(t):
    k = F.col("c_custkey")
    y = 2020 + k % 5
    row = lambda d, label: F.concat(F.lit("<tr><td>"), d, F.lit("</td>\n<td> "), label, F.lit("</td></tr>"))
    page = F.concat(
        F.lit("<h1>Calendar</h1><h2 class=x>Late Summer dates related to the Fall "), y, F.lit(" term</h2><table><tr><th>Date</th><th>Event</th></tr>"),
        row(F.concat(F.lit("December "), 20 + k % 10, F.lit(" &ndash; Jan. "), 1 + k % 9), F.lit("<b>Appointment</b> window &amp; more")),
        row(F.concat(F.lit("Dec. "), 1 + k % 20, F.lit(", "), y), F.lit("Last day of classes; last day to drop")),
        row(F.lit("soon"), F.lit("First day of labs")), row(F.lit("May 1"), F.lit("A holiday")),
        row(F.lit("Nov 15"), F.concat(F.lit("Registration for Spring "), y + 1, F.lit(" opens"))),
        F.lit("</table><dl><dt>Sept "), 1 + k % 28, F.lit("</dt><dd>Classes begin</dd><dt>Sept 30</dt><dd>Classes begin</dd></dl>"),
    )
    return calendars.milestones(calendars.calendar_rows(t.dealt("customer").select("c_custkey", page.alias("html")), "c_custkey", "html"), "c_custkey")


@query(_MILESTONES)
def s14_milestones(spark, t):
    """The milestones of calendar pages, of the terms that their headings name or that registration is for."""
    return _milestones(t)


@query(f"with m as ({_MILESTONES}) select term, min(case when kind = 'term_start' then left(starts_at, 10) end) as starts_on, max(case when label like 'Last day of classes%' then left(starts_at, 10) end) as ends_on from m group by 1")
def s14_term_bounds(spark, t):
    return calendars.term_bounds(_milestones(t))
