"""Sources (S) on payloads and texts laid out from the driver's tables; the SQL computes from those tables directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.plans.registry import query
from lumenforge.sources import html_tables, payloads, transcripts


@query("""
select o_custkey, o_orderkey as review_id, count(*) over (partition by o_custkey) as total_reviews, 'Ann ' || o_orderpriority as instructor_name,
'COMS' || (1000 + o_orderkey % 900) || 'W' as course_id, o_orderdate as posted_at, o_orderstatus || ' body' as body, case when o_orderkey % 7 between 1 and 5 then (o_orderkey % 7)::double end as rating from orders
""")
def s19_review_pages(spark, t):
    review = F.struct(
        F.col("o_orderkey").alias("review_id"),
        F.concat("o_orderstatus", F.lit(" body")).alias("content"),
        (F.col("o_orderkey") % 7).alias("rating"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("submission_date"),
        F.struct(F.lit("Ann").alias("first_name"), F.col("o_orderpriority").alias("last_name")).alias("professor_header"),
        F.struct(F.format_string("coms %dw", 1000 + F.col("o_orderkey") % 900).alias("course_code")).alias("course_header"),
    )
    pages = t("orders").groupBy("o_custkey").agg(F.count("*").alias("number_of_reviews"), F.collect_list(review).alias("reviews"))
    rows = payloads.review_records(pages.select("o_custkey", F.to_json(F.struct("number_of_reviews", "reviews")).alias("body")), "body")
    return rows.select("o_custkey", "review_id", "total_reviews", "instructor_name", "course_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "body", "rating")


@query(r"""
with d as (select doc_id, regexp_replace(coalesce(source, '') || chr(10) || chr(10) || coalesce(text, ''), '^\s+|\s+$', '', 'g') as body from documents)
select 't3_' || doc_id as post_id, length(body) as n, md5(body) as digest from d where length(body) >= 40 and (contains(lower(body), 'the') or contains(lower(body), 'und'))
""")
def s20_link_listing(spark, t):
    link = F.struct(F.lit("t3").alias("kind"), F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("selftext"), F.lit("/r/").alias("permalink")).alias("data"))
    listing = t("documents").select(F.to_json(F.struct(F.struct(F.array(link).alias("children")).alias("data"))).alias("body"))
    return payloads.link_records(listing, "body", ['"The"', " und ", ""]).select("post_id", F.length("body").cast("long").alias("n"), F.md5("body").alias("digest"))


@query("""
with s as (select year(o_orderdate) || '1' as term_code, 'PART' || (l_partkey % 100000) || 'W' as course_id, l_linenumber::varchar as section_code, l_orderkey::varchar as call_number, o_orderdate as seen, row_number() over (partition by l_orderkey order by l_linenumber, 'part' || (l_partkey % 100000) || 'w') as i,
(case when (l_quantity * 30)::int + 75 <= 1440 then 1 else 0 end)::bigint as n_meetings from lineitem join orders on o_orderkey = l_orderkey)
select term_code || course_id || section_code as section_key, arg_max(call_number, (n_meetings, seen, i, call_number)) as call_number, max(n_meetings) as n_meetings from s group by 1
""")
def s21_captured_sections(spark, t):
    start = (F.col("l_quantity") * 30).cast("int")
    meeting = F.struct(F.lit("Mon").alias("weekday"), start.alias("start_minute"), (start + 75).alias("end_minute"))
    section = F.struct(
        F.concat(F.year("o_orderdate"), F.lit("1")).alias("term_calendar_code"), F.col("l_linenumber").cast("string").alias("section_code"), F.col("l_orderkey").cast("string").alias("class_number"), F.array(meeting, meeting).alias("meeting_details")
    )
    course = F.struct(F.concat(F.lit("part"), F.col("l_partkey") % 100000, F.lit("w")).alias("course_identifier"), F.struct(F.array(section).alias("classes")).alias("class_data"))
    lines = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    orders = lines.groupBy("o_orderkey", "o_orderdate").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", course.alias("c")))).alias("cs"))
    body = F.to_json(F.struct(F.struct(F.col("cs.c").alias("courses")).alias("data")))
    return payloads.captured_sections(orders.select("o_orderdate", body.alias("body")), "body", "o_orderdate").select("section_key", "call_number", F.size("meetings").cast("long").alias("n_meetings"))


@query("""
with l as (select o_custkey, 'COMS' || (1000 + o_orderkey % 300) || 'W' as course_id, o_orderkey, (case when month(o_orderdate) > 6 then 'Fall ' else 'Spring ' end) || year(o_orderdate) as term, ['A-', 'W', 'P', 'B+', null][(o_orderkey % 5 + 1)::int] as grade from orders)
select o_custkey, course_id, arg_min(term, o_orderkey) as term, (array_agg(grade order by o_orderkey))[1] as grade, 3.0::double as points,
case (min(o_orderkey) % 5)::int when 1 then 'withdrawn' when 2 then 'pass_fail' when 4 then 'in_progress' else '' end as warnings from l group by 1, 2
""")
def s17_transcripts(spark, t):
    term = F.concat(F.when(F.month("o_orderdate") > 6, "FALL ").otherwise("spring "), F.year("o_orderdate"))
    grade = F.element_at(F.array(*[F.lit(g) for g in ("A-", "W", "P", "B+", "")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    line = F.concat(term, F.lit("\r\n  COMS   W"), 1000 + F.col("o_orderkey") % 300, F.lit("  Of Things  3 pts "), grade)
    texts = t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return transcripts.candidates(texts, "o_custkey", "text").select("o_custkey", "course_id", "term", "grade", "points", F.array_join("warnings", ",").alias("warnings"))


@query("""
select o_orderkey, '20263PART' || (1000 + o_custkey % 9000) || 'W00' || (o_orderkey % 10) as section_key, 'PART' || (1000 + o_custkey % 9000) || 'W' as course_id, o_orderkey::varchar as call_number,
case when o_orderkey % 3 = 0 then 0 else 2 end::bigint as n_instructors, 'Ann & Co' as first_name, o_custkey % 60 as enrollment_count,
case when o_orderkey % 5 = 0 then 'waitlist' when o_custkey % 60 >= 40 then 'full' else 'open' end as status from orders where o_orderstatus <> 'P'
""")
def s11_section_details(spark, t):
    row = lambda label, value: F.concat(F.lit(f"<tr valign=top><TH>{label}:</TH><td><b>"), value, F.lit("</b></td></tr>\n"))
    key = F.concat(F.lit("20263PART"), 1000 + F.col("o_custkey") % 9000, F.lit("W00"), F.col("o_orderkey") % 10)
    body = F.concat(
        F.when(F.col("o_orderstatus") == "P", "<title> Section removed </title>").otherwise("<title>x</title>"), F.lit("<table>"),
        row("Section key", key), row("Call Number", F.col("o_orderkey").cast("string")), row("Note", F.lit("Ann &amp; Co<!-- </b> -->")),
        row("Instructors", F.when(F.col("o_orderkey") % 3 == 0, "TBA").otherwise("Ann Lee and<br>Bo&nbsp;Li")),
        row("Enrollment", F.concat(F.col("o_custkey") % 60, F.lit(" students (40 max) as of 9:14AM Monday"))),
        row("Status", F.when(F.col("o_orderkey") % 5 == 0, "Wait List").otherwise("")), F.lit("</table>"),
    )
    pages = t.dealt("orders").select("o_orderkey", body.alias("html"))
    got = html_tables.section_details(pages, "o_orderkey", "html").join(html_tables.labelled_fields(pages, "o_orderkey", "html"), "o_orderkey")
    return got.select("o_orderkey", "section_key", "course_id", "call_number", F.size("instructors").cast("long").alias("n_instructors"), F.col("fields")["note"].alias("first_name"), "enrollment_count", "status")


@query("""
with s as (select upper(replace(left(p_type, 4), ' ', '_')) as subject_code, 'Fall' || (2000 + p_size) as term, 'The ' || p_type || ' & more' as subject_name from part)
select subject_code, min(subject_name) as subject_name, array_to_string(list_sort(list_distinct(list(term))), ',') as terms from s group by 1
""")
def s13_subject_index(spark, t):
    code = F.upper(F.replace(F.left("p_type", F.lit(4)), F.lit(" "), F.lit("_")))
    page = F.concat(F.lit("<table><tr><td>The "), "p_type", F.lit("  &amp; more</td><td><a class=x href='/listing/"), code, F.lit("_Fall"), 2000 + F.col("p_size"), F.lit(".html'>Fall</a><tr><td>no link</td><td>-</td></table>"))
    return html_tables.subject_index(t("part").select(page.alias("html")), "html").withColumn("terms", F.array_join("terms", ","))
