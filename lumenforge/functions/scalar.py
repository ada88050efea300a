"""Column functions shared by the operators; all stay inside Spark's code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value", fixed values.
BLANKS = ("n/a", "na", "none", "tba", "tbd", "to be announced", "-", "--", "null")
EARTH_RADIUS_M = 6_371_000
WALK_DETOUR, WALK_M_PER_MIN = 1.3, 78


def round_half_up(x: Column, digits: int) -> Column:
    """Rounding half toward plus infinity."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def clean_text(x: Column) -> Column:
    """White space of all kinds, zero-width characters included, as single spaces, trimmed."""
    return F.trim(F.regexp_replace(x, "[\\s\\u00a0\\u200b-\\u200d\\ufeff]+", " "))


def normalize_label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_text(x)), ":+$", ""))


def blank_to_null(x: Column) -> Column:
    t = clean_text(x)
    return F.when(~F.lower(t).isin(*BLANKS) & (t != ""), t)


def normalize_name(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, "\\s+", " ")))


def _accented() -> tuple[str, str]:
    """Latin letters that Unicode decomposes into an ASCII letter and marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0].lower()) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    kept = [(c, d) for c, d in pairs if d != c and d.isascii() and d.isalpha()]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_ACCENTED, _PLAIN = _accented()


def fold(x: Column) -> Column:
    """Lower case without Latin diacritics (composed or as combining marks), other characters as single spaces."""
    plain = F.translate(F.regexp_replace(F.lower(x), "[\\u0300-\\u036f]", ""), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(fold(x), " ", "-")


def tokens(x: Column) -> Column:
    """Folded words, and behind each mixed word its runs of letters and of digits."""
    words = F.array_remove(F.split(fold(x), " "), "")
    mixed = "[a-z][0-9]|[0-9][a-z]"  # splitting compiles its pattern at each call, so only mixed words are split

    def parts(w):
        return F.when(w.rlike(mixed), F.concat(F.array(w), F.split(w, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])"))).otherwise(F.array(w))

    return F.flatten(F.transform(words, parts))


def open_seat_by_status(status: Column, count: Column, cap: Column) -> Column:
    """Closed and full are never open, open always is; else the counts decide, unknown counts as not open."""
    return F.when(status.isin("closed", "full"), False).when(status == "open", True).otherwise(F.coalesce(count < cap, F.lit(False)))


def open_seat_by_count(status: Column, count: Column, cap: Column) -> Column:
    """Closed and full are never open; counts win over the label, which decides where they are missing."""
    return (
        F.when(status.isin("closed", "full"), False)
        .when(count.isNull() | cap.isNull(), F.coalesce(status == "open", F.lit(False)))
        .otherwise(count < cap)
    )


def open_seat_tristate(status: Column, count: Column, cap: Column) -> Column:
    """Null where nothing is known; a waitlist is not open."""
    return F.when(status.isin("closed", "full", "waitlist"), False).when(count.isNotNull() & cap.isNotNull(), count < cap).when(status == "open", True)


def minutes_label(m: Column) -> Column:
    """Minutes from midnight as h:mm with am or pm."""
    h = F.floor(m / 60) % 12
    return F.format_string("%d:%02d %s", F.when(h == 0, 12).otherwise(h), (m % 60).cast("long"), F.when(m < 720, "am").otherwise("pm"))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def walk_minutes(metres: Column) -> Column:
    """Whole minutes on foot along streets, one at least."""
    return F.greatest(F.lit(1), F.floor(metres * WALK_DETOUR / WALK_M_PER_MIN + 0.5)).cast("long")


def recency_weight(age_days: Column, half_life_days: float = 730.0) -> Column:
    """Halves every two years, at least 0.05; undated counts a quarter, the future fully."""
    aged = F.greatest(F.lit(0.05), round_half_up(F.pow(F.lit(0.5), age_days / half_life_days), 6))
    return F.when(age_days.isNull(), 0.25).when(age_days <= 0, 1.0).otherwise(aged)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open intervals: touching ends do not overlap."""
    return (s1 < e2) & (s2 < e1)
