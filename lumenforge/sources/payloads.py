"""JSON payloads as tables: review pages, search headers, link listings and captured sections.

Each function takes a table with one payload a row and returns one row a record; a payload that is null, no JSON or of another shape
gives no rows. Extra columns of the payload table stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADERS = "professor_header struct<first_name string, last_name string, uni string>, course_header struct<course_code string, course_name string>"
REVIEW_PAGE = f"number_of_reviews bigint, reviews array<struct<review_id bigint, content string, workload string, rating double, submission_date string, agree_count bigint, disagree_count bigint, funny_count bigint, {_HEADERS}>>"
LISTING = "data struct<children array<struct<kind string, data struct<id string, title string, selftext string, permalink string, created_utc double, subreddit string, score bigint, num_comments bigint>>>>"
MEETING = "struct<weekday string, start_minute int, end_minute int, building string, room string>"
SEARCH = f"data struct<courses array<struct<course_identifier string, class_data struct<classes array<struct<term_calendar_code string, section_code string, class_number string, meeting_details array<{MEETING}>>>>>>>"

# The lengths and shapes of identifiers and the shortest post.
MIN_BODY_CHARS = 40
TERM_CODE = r"^\d{4,6}$"
COURSE_ID = r"^[A-Z&]{2,6}\d{1,5}[A-Z]{0,3}$"
SECTION_CODE = r"^[A-Z0-9]{1,5}$"
CALL_NUMBER = r"^\d{1,10}$"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _utc(x: Column) -> Column:
    """A naive timestamp is read as UTC; an unreadable one is null."""
    zoned = F.when(F.trim(x).rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), F.trim(x)).otherwise(F.concat(F.trim(x), F.lit("Z")))
    return F.try_to_timestamp(zoned)


def review_records(pages: DataFrame, body: str) -> DataFrame:
    """One row a review: id, name, course code, UTC instant, body, workload text and the rating where it is within 1 to 5.

    Reviews without an id or a body are malformed and left out; ``total_reviews`` is what the page claims over all pages.
    """
    page = pages.withColumn("_p", F.from_json(body, REVIEW_PAGE)).withColumn("_r", F.explode("_p.reviews")).where("_r.review_id is not null and _r.content is not null")
    name = F.nullif(F.trim(F.concat_ws(" ", "_r.professor_header.first_name", "_r.professor_header.last_name")), F.lit(""))
    return page.select(
        *[c for c in pages.columns if c != body],
        F.col("_r.review_id").alias("review_id"),
        F.col("_p.number_of_reviews").alias("total_reviews"),
        name.alias("instructor_name"),
        F.upper(F.regexp_replace("_r.course_header.course_code", r"\s+", "")).alias("course_id"),
        _utc(F.col("_r.submission_date")).alias("posted_at"),
        F.col("_r.content").alias("body"),
        F.col("_r.workload").alias("workload"),
        F.when(F.col("_r.rating").between(1, 5), F.col("_r.rating")).alias("rating"),
    )


def search_headers(payloads: DataFrame, body: str, kind: str) -> DataFrame:
    """One row a header of ``kind`` (professor or course) in a search payload, which is an array; entries without one are left out."""
    rows = payloads.withColumn("_h", F.explode(F.from_json(body, f"array<struct<{_HEADERS}>>")))
    return rows.where(F.col(f"_h.{kind}_header").isNotNull()).select(*[c for c in payloads.columns if c != body], F.col(f"_h.{kind}_header.*"))


def link_records(listings: DataFrame, body: str, needles: list[str]) -> DataFrame:
    """One row a post of a listing whose title and text together have MIN_BODY_CHARS and literally mention a needle, in any case."""
    wanted = [n for n in (x.replace('"', "").lower().strip() for x in needles) if n]
    rows = listings.withColumn("_c", F.explode(F.from_json(body, LISTING)["data"]["children"])).where("_c.data.id is not null and _c.data.permalink is not null")
    text = F.regexp_replace(F.concat(_text(F.col("_c.data.title")), F.lit("\n\n"), _text(F.col("_c.data.selftext"))), r"^\s+|\s+$", "")
    out = rows.select(*[c for c in listings.columns if c != body], F.concat(F.lit("t3_"), "_c.data.id").alias("post_id"), text.alias("body"), F.timestamp_seconds(F.coalesce("_c.data.created_utc", F.lit(0))).alias("posted_at"), "_c.data.permalink")
    mentions = F.exists(F.array(*[F.lit(n) for n in wanted]).cast("array<string>"), lambda n: F.contains(F.lower("body"), n))
    return out.where((F.length("body") >= MIN_BODY_CHARS) & mentions)


def _identity(x: Column, shape: str) -> Column:
    clean = F.upper(F.trim(x))
    return F.when(clean.rlike(shape), clean)


def captured_sections(payloads: DataFrame, body: str, captured_at: str) -> DataFrame:
    """One row a section with a whole identity; meetings with a sane interval, each once; of repeats the one with most meetings, then the later.

    A payload whose ``captured_at`` is null gives no rows.
    """
    courses = payloads.where(F.col(captured_at).isNotNull()).select(F.col(captured_at).alias("observed_at"), F.posexplode(F.from_json(body, SEARCH)["data"]["courses"]).alias("_i", "_c"))
    rows = courses.select("observed_at", "_i", F.col("_c.course_identifier").alias("_course"), F.posexplode("_c.class_data.classes").alias("_j", "_s"))
    sane = F.array_distinct(F.filter(F.coalesce("_s.meeting_details", F.array().cast(f"array<{MEETING}>")), lambda m: (m["start_minute"] >= 0) & (m["end_minute"] <= 1440) & (m["end_minute"] > m["start_minute"]) & m["weekday"].isNotNull()))
    rows = rows.select(
        "observed_at", "_i", "_j",
        _identity(F.col("_s.term_calendar_code"), TERM_CODE).alias("term_code"),
        _identity(F.col("_course"), COURSE_ID).alias("course_id"),
        _identity(F.col("_s.section_code"), SECTION_CODE).alias("section_code"),
        _identity(F.col("_s.class_number"), CALL_NUMBER).alias("call_number"),
        sane.alias("meetings"),
    ).dropna(subset=["term_code", "course_id", "section_code", "call_number"])
    keyed = rows.withColumn("section_key", F.concat("term_code", "course_id", "section_code"))
    best = keyed.groupBy("section_key").agg(F.max_by(F.struct("term_code", "course_id", "section_code", "call_number", "meetings", "observed_at"), F.struct(F.size("meetings"), "observed_at", "_i", "_j", "call_number")).alias("_b"))
    return best.select("section_key", "_b.*")
