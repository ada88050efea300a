"""Academic calendars: milestones of the terms that a page's headings name, and what bounds a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.functions import dates
from lumenforge.sources.html_tables import decoded_text

#: What names a milestone, the most telling first, and the row that ends a term.
KINDS = [
    ("add_drop_deadline", r"(?i)\b(last day|deadline).{0,40}\b(add|drop|change)\b"),
    ("add_drop_deadline", r"(?i)\badd[/\s-]*drop\b.{0,30}\b(deadline|ends?|closes?)\b"),
    ("appointment_window", r"(?i)\bappointment"),
    ("appointment_window", r"(?i)\b(senior|junior|sophomore|first[- ]year|graduate)s?\b.{0,30}\bregist"),
    ("registration_open", r"(?i)\bregistration\b.{0,30}\b(opens?|begins?|starts?)\b"),
    ("registration_open", r"(?i)\b(course|class)\s+registration\b"),
    ("term_start", r"(?i)\b(first day of|classes begin|instruction begins)\b"),
]
LAST_DAY = r"(?i)\blast day of (classes|instruction)\b"
LABEL_LENGTH = 200
_PIECE = r"(?is)(<(?:h[1-6]|tr|dt|dd)\b[^>]*>.*?)(?=<(?:h[1-6]|tr|dt|dd)\b|</(?:h[1-6]|tr|table|dl)>|\z)"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]>|\z)"


def milestone_kind(label: Column) -> Column:
    """The kind that a label clearly names; null for others, which are dropped rather than guessed."""
    out = F.when(label.rlike(KINDS[0][1]), KINDS[0][0])
    for kind, test in KINDS[1:]:
        out = out.when(label.rlike(test), kind)
    return out


def registration_term(label: Column) -> Column:
    """The term that a label says registration is for; other terms that a label mentions are not its own."""
    season = r"(spring|summer|fall|autumn)\s+(20\d{2})"
    ahead, behind = rf"(?i)\bregistration\s+(?:for\s+)?(?:the\s+)?{season}", rf"(?i)\b{season}\s+(?:\w+\s+){{0,2}}registration\b"
    said = F.when(label.rlike(ahead), F.regexp_extract(label, ahead, 0)).when(label.rlike(behind), F.regexp_extract(label, behind, 0))
    return dates.term_code(said)


def calendar_rows(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, row_no, term, date_text, label): rows of two cells and pairs of dt and dd under the nearest heading before them; a row without one has no term."""
    pieces = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(_PIECE), F.lit(1))).alias("row_no", "_piece"))
    tag = F.lower(F.regexp_extract("_piece", r"^<(\w+)", 1))
    cells = F.regexp_extract_all("_piece", F.lit(_CELL), F.lit(1))
    pieces = pieces.withColumn("_tag", tag).withColumn("_texts", decoded_text(F.when(tag == "tr", cells).otherwise(F.array(F.regexp_replace("_piece", r"(?s)^<[^>]*>", "")))))
    w = Window.partitionBy(id_col).orderBy("row_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("_tag").startswith("h"), dates.term_code(F.col("_texts")[0]))
    pieces = pieces.withColumn("term", F.last(heading, ignorenulls=True).over(so_far)).withColumn("_said", F.when(F.lag("_tag").over(w) == "dt", F.lag(F.get("_texts", F.lit(0))).over(w)))
    pair = (F.col("_tag") == "tr") & (F.size("_texts") == 2)
    rows = pieces.where(pair | ((F.col("_tag") == "dd") & F.col("_said").isNotNull()))
    return rows.select(id_col, "row_no", "term", F.when(pair, F.col("_texts")[0]).otherwise(F.col("_said")).alias("date_text"), F.when(pair, F.get("_texts", F.lit(1))).otherwise(F.col("_texts")[0]).alias("label"))


def milestones(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, term, kind, label, starts_at, ends_at) of the rows whose label names a kind and whose date can be read; of equal labels the first counts.

    A spring term's dates without a year lie in the year before.
    """
    year = F.left("term", F.lit(4)).cast("int")
    fallback = F.when(F.col("term").endswith("1"), year - 1).otherwise(year)
    rows = rows.withColumn("term", F.coalesce(registration_term(F.col("label")), "term"))
    found = rows.where("term is not null").withColumns({"kind": milestone_kind(F.col("label")), "_d": dates.calendar_range(F.col("date_text"), fallback)})
    found = found.where(F.col("kind").isNotNull() & F.col("_d").isNotNull()).withColumn("label", F.left("label", F.lit(LABEL_LENGTH)))
    return found.groupBy(id_col, "term", "kind", "label").agg(F.min_by("_d", "row_no").alias("_d")).select(id_col, "term", "kind", "label", "_d.starts_at", "_d.ends_at")


def term_bounds(found: DataFrame) -> DataFrame:
    """(term, starts_on, ends_on): the earliest start of classes and the latest last day of classes, as local dates; null where no page has one."""
    day = F.left("starts_at", F.lit(10))
    return found.groupBy("term").agg(F.min(F.when(F.col("kind") == "term_start", day)).alias("starts_on"), F.max(F.when(F.col("label").rlike(LAST_DAY), day)).alias("ends_on"))
