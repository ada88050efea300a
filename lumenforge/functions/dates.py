"""Times, dates, places and terms as pages write them, read by column functions. Null, empty and unreadable texts give null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The months' names and short forms, the seasons' digits, the place whose clock pages show.
MONTHS = "january february march april may june july august september october november december".split()
SEASONS = {"spring": "1", "summer": "2", "fall": "3", "autumn": "3"}
ZONE = "America/New_York"
FIRST_YEAR, LAST_YEAR = 1990, 2100

_DAY = r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:\s*,?\s*(\d{4}))?"
_RANGE = _DAY + r"\s*(?:[–—-]|to|through)\s*(?:([A-Za-z]{3,9})\.?\s+)?(\d{1,2})(?:\s*,?\s*(\d{4}))?"


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s ​]+", " "))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it: a column that is used twice would double its whole tree each time."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _part(x: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def _number(x: Column, pattern: str, i: int) -> Column:
    return _part(x, pattern, i).cast("int")


def clock_minute(x: Column) -> Column:
    """Minutes from midnight of "7:40pm", "7 P.M.", "19:40" or "1940"."""
    t = F.upper(F.regexp_replace(_clean(x), r"\.", ""))
    colon, hour, plain = r"^(\d{1,2}):(\d{2})\s*([AP]M?)?$", r"^(\d{1,2})\s*([AP]M?)$", r"^(\d{1,2})(\d{2})$"

    def at(h: Column, m: Column, half: Column) -> Column:
        twelve = F.when(h.between(1, 12), h % 12 + F.when(half.startswith("P"), 12).otherwise(0))
        full = F.when(half.isNotNull(), twelve).when(h <= 23, h)
        return F.when(m <= 59, full * 60 + m)

    return (
        F.when(t.rlike(colon), at(_number(t, colon, 1), _number(t, colon, 2), _part(t, colon, 3)))
        .when(t.rlike(hour), at(_number(t, hour, 1), F.lit(0), _part(t, hour, 2)))
        .when(t.rlike(plain), at(_number(t, plain, 1), _number(t, plain, 2), F.lit(None).cast("string")))
    )


def time_range(x: Column) -> Column:
    """(start, end) in minutes of "9:00 - 10:15am" or "1010 1240"; a start that cannot be read takes the end's half of the day."""
    pieces = F.filter(F.split(_clean(x), r"(?i)\s*(?:-|–|—|\bto\b)\s*|\s+"), lambda p: p != "")
    first, last = F.get(pieces, F.lit(0)), F.get(pieces, F.size(pieces) - 1)
    end = clock_minute(last)
    half = F.when(F.upper(F.substr(last, F.greatest(F.length(last) - 1, F.lit(1)))).contains("P"), "PM").otherwise("AM")
    borrowed = F.when(last.rlike(r"(?i)[AP]\.?M?\.?$"), clock_minute(F.concat(first, half)))
    start = F.coalesce(clock_minute(first), borrowed)
    return F.when((F.size(pieces) >= 2) & start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def location(x: Column) -> Column:
    """(building, room) of "142 Uris Hall"; places to be announced have neither, names without a number no room."""
    t = _clean(x)
    none = t.rlike(r"(?i)^(room\s+)?(tba|tbd|to be announced)$") | t.rlike(r"(?i)^none(\s+none)?$") | (t == "")
    numbered = r"^(\d+[A-Za-z]?)\s+(.+)$"
    building = F.when(none, None).when(t.rlike(numbered), F.regexp_extract(t, numbered, 2)).otherwise(t)
    return F.struct(building.alias("building"), F.when(~none, _part(t, numbered, 1)).alias("room"))


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or its first three letters, or sept."""
    n = F.lower(name)
    return reduce(lambda c, m: c.when(n.isin(m[1], m[1][:3], *(["sept"] if m[0] == 9 else [])), m[0]), enumerate(MONTHS[1:], 2), F.when(n.isin(MONTHS[0], MONTHS[0][:3]), 1))


def _offset(instant: Column, zone: str) -> Column:
    """Seconds that the zone's clock is ahead of UTC at an instant in seconds."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(instant), zone)) - instant


def wall_clock(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str = ZONE) -> Column:
    """An ISO 8601 string of a local clock's reading with its offset, whatever the session's zone.

    The offset is looked up as if the reading were UTC and once more at the instant that this gives: a reading in the hour that spring skips
    gets summer's offset, one in the hour that autumn repeats the first of both.
    """
    naive = F.unix_date(F.date_add(F.make_date(year, month, F.lit(1)), day - 1)).cast("long") * 86400 + hour * 3600 + minute * 60 + second
    first = _bound(naive, lambda n: F.struct(n.alias("n"), (n - _offset(n, zone)).alias("at")))
    offset = _bound(first, lambda f: _offset(f["at"], zone))

    def written(o: Column) -> Column:
        size = F.abs(o)
        return F.format_string("%04d-%02d-%02dT%02d:%02d:%02d%s%02d:%02d", year, month, day, hour, minute, second, F.when(o >= 0, "+").otherwise("-"), F.floor(size / 3600), F.floor(size / 60) % 60)

    return _bound(offset, written)


def calendar_range(x: Column, fallback_year: Column) -> Column:
    """(starts_at, ends_at) of "October 27 - November 7, 2026", "Oct 27-31" or "Oct 27": the first day's midnight and the last second of the last day.

    Years that are missing come from the other end, else from ``fallback_year``; a range into an earlier month ends in the next year. A single day has no end.
    """
    zero = F.lit(0)

    def iso(date: Column, end: bool = False) -> Column:
        clock = (F.lit(23), F.lit(59), F.lit(59)) if end else (zero, zero, zero)
        good = date["y"].between(FIRST_YEAR, LAST_YEAR) & date["m"].between(1, 12) & date["d"].between(1, 31)
        return F.when(good, wall_clock(date["y"], date["m"], date["d"], *clock))

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def read(t: Column) -> Column:
        months = F.struct(month_number(_part(t, _RANGE, 1)).alias("a"), F.when(_part(t, _RANGE, 4).isNull(), month_number(_part(t, _RANGE, 1))).otherwise(month_number(_part(t, _RANGE, 4))).alias("b"))
        first = F.coalesce(_number(t, _RANGE, 3), _number(t, _RANGE, 6), fallback_year)

        def dated(p: Column) -> Column:
            later = F.coalesce(_number(t, _RANGE, 6), F.when(p["m"]["b"] < p["m"]["a"], p["y"] + 1).otherwise(p["y"]))
            one = date(F.coalesce(_number(t, _DAY, 3), fallback_year), month_number(_part(t, _DAY, 1)), _number(t, _DAY, 2))
            return F.struct(date(p["y"], p["m"]["a"], _number(t, _RANGE, 2)).alias("from"), date(later, p["m"]["b"], _number(t, _RANGE, 5)).alias("to"), one.alias("one"))

        return _bound(F.struct(months.alias("m"), first.alias("y")), dated)

    def made(p: Column) -> Column:
        return F.struct(_bound(p["from"], lambda d: iso(d)).alias("a"), _bound(p["to"], lambda d: iso(d, end=True)).alias("b"), _bound(p["one"], lambda d: iso(d)).alias("c"))

    def chosen(p: Column) -> Column:
        both = p["a"].isNotNull() & p["b"].isNotNull()
        none = F.lit(None).cast("string")
        return F.when(both, F.struct(p["a"].alias("starts_at"), p["b"].alias("ends_at"))).when(p["c"].isNotNull(), F.struct(p["c"].alias("starts_at"), none.alias("ends_at")))

    return _bound(_bound(_bound(_clean(x), read), made), chosen)


def _season(x: Column) -> Column:
    return reduce(lambda c, s: c.when(F.lower(x) == s[0], s[1]), list(SEASONS.items())[1:], F.when(F.lower(x) == "spring", SEASONS["spring"]))


def term_code(heading: Column) -> Column:
    """The code, as 20263, of "Fall 2026" or "2026 Fall"; a season beside a year wins over the first season and year anywhere."""
    t = _clean(heading)
    after, before = r"(?i)\b(spring|summer|fall|autumn)\s+(?:term\s+)?(20\d{2})\b", r"(?i)\b(20\d{2})\s+(spring|summer|fall|autumn)\b"
    loose = F.concat(_part(t, r"\b(20\d{2})\b", 1), _season(_part(t, r"(?i)\b(spring|summer|fall|autumn)\b", 1)))
    return F.when(t.rlike(after), F.concat(F.regexp_extract(t, after, 2), _season(F.regexp_extract(t, after, 1)))).when(t.rlike(before), F.concat(F.regexp_extract(t, before, 1), _season(F.regexp_extract(t, before, 2)))).otherwise(loose)


def calendar_year(term: Column, month: Column) -> Column:
    """The calendar year of a month that a term's calendar prints without one: August to July is one academic year, summer lies in its own."""
    year = F.left(term, F.lit(4)).cast("int")
    season = F.substr(term, F.lit(5))
    opens = F.when(season == SEASONS["spring"], year - 1).otherwise(year)
    return F.when(season == SEASONS["summer"], year).when(month >= 8, opens).otherwise(opens + 1)


def course_number(x: Column) -> Column:
    """(number, qualifier) of "W1002", "1002W" or "4113"."""
    shape = r"^([A-Z]{0,3})(\d{1,5})([A-Z]{0,3})$"
    t = F.upper(F.regexp_replace(_clean(x), " ", ""))
    return F.when(t.rlike(shape), F.struct(_number(t, shape, 2).alias("number"), F.coalesce(_part(t, shape, 1), _part(t, shape, 3)).alias("qualifier")))
