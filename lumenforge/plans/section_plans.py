"""Queries of sections' filters, counts and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.functions.scalar import haversine_m, slug, walk_minutes
from lumenforge.operators import relational, schedule, sections
from lumenforge.plans.joins import MINUTES, minutes
from lumenforge.plans.registry import query


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) = 1998)")
def f6_in_term(spark, t):
    o = t("orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    return t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query(f"with m as ({MINUTES}) select user_id, day::varchar as day from m group by user_id, m.day having min(s) >= 300 and max(e) <= 1300")
def f8_time_window(spark, t):
    """Everything starts and ends within the window; unknown times fail."""
    return sections.within_window(minutes(t), ["user_id", "day"], "s", "e", 300, 1300).withColumn("day", F.col("day").cast("string"))


@query("select l_orderkey, list_has_any(list(distinct l_suppkey), [3, 7, 9]::bigint[]) as taught_by from lineitem group by 1")
def f9_instructors(spark, t):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_suppkey").isin(3, 7, 9)).alias("taught_by"))


@query("with s as (select l_partkey, bool_or(l_returnflag = 'N') as open from lineitem group by 1) select p_partkey from part left join s on l_partkey = p_partkey where coalesce(open, false)")
def f10_open_only(spark, t):
    """With seats known, only what is open; without an overlay the filter does nothing."""
    seats = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("open"))
    return sections.open_only(t("part").select("p_partkey"), seats, "p_partkey")


@query("""
with s as (select p_brand, p_partkey, contains(p_name, 'red')::bigint + contains(p_name, 'widget')::bigint as n from part), b as (select p_brand, max(n) as best, min(n) as worst from s group by 1)
select p_brand, p_partkey from s join b using (p_brand) where best > 0 and n = best and worst < best
""")
def f14_named_by_query(spark, t):
    """Of each course the sections that cover most of the query's words, where that tells them apart."""
    return sections.named_by_query(t("part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], F.col("p_name"), ["red", "widget"]).select("p_brand", "p_partkey")


@query("""
select p_partkey from part where case p_type when 'PROMO' then false when 'SMALL' then true when 'ECONOMY' then p_partkey not in (select s_suppkey from supplier) else true end
""")
def f20_school_gate(spark, t):
    """Courses that a school may take: its own, those of no school, and shared ones that are not on the short list of another."""
    barred = t("supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return sections.admitted(t("part"), "p_partkey", F.col("p_type"), own={"SMALL"}, others={"PROMO"}, shared="ECONOMY", barred=barred).select("p_partkey")


@query("""
select source, count(*) as n_reviews, count(quality) as n_rated, count(*) - count(quality) as n_unrated, min(documents.doc_id) as first_id, max(documents.doc_id) as last_id from documents left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id) group by 1
""")
def a8_coverage(spark, t):
    """Reviews and rated reviews of each source, and their range."""
    rated = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = t("documents").select("doc_id", "source").join(rated, "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n_reviews"), F.count("quality").alias("n_rated"), F.count_if(F.col("quality").isNull()).alias("n_unrated"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("select l_suppkey, count(*) as n_sections, count(distinct p_brand) as n_subjects from lineitem join part on p_partkey = l_partkey group by 1")
def a12_instructor_list(spark, t):
    l = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).join(t("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return l.groupBy("l_suppkey", "p_brand").agg(F.sum("n").alias("n")).groupBy("l_suppkey").agg(F.sum("n").alias("n_sections"), F.count("*").alias("n_subjects"))


@query("select l_orderkey, list_filter(['R', 'A', 'N'], lambda x: list_contains(list(distinct l_returnflag), x)) as keys from lineitem group by 1")
def a16_satisfied_keys(spark, t):
    """Satisfied keys in the order they are declared."""
    f = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return f.select("l_orderkey", F.filter(F.array(F.lit("R"), F.lit("A"), F.lit("N")), lambda x: F.array_contains("f", x)).alias("keys"))


@query(f"""
with m as ({MINUTES}), x as (select user_id, day, event_id, lead(event_id) over (partition by user_id, day order by s, e, event_id) as nxt from m)
select user_id, dayofweek(day)::bigint as weekday, sum(greatest(1, floor(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians((nxt % 90 - event_id % 90) / 1000.0) / 2), 2)))) * 1.3 / 78 + 0.5)))::bigint as walk from x where nxt is not null group by all
""")
def a18_walk_by_weekday(spark, t):
    """Minutes on foot between consecutive items, by weekday."""
    legs = schedule.consecutive(minutes(t), ["user_id", "day"], ["s", "e", "event_id"], ["event_id"])
    lat = lambda c: F.col(c) % 90 / 1000.0
    metres = haversine_m(lat("event_id"), F.lit(0.0), lat("next_event_id"), F.lit(0.0))
    return legs.groupBy("user_id", (F.dayofweek("day") - 1).cast("long").alias("weekday")).agg(F.sum(walk_minutes(metres)).alias("walk"))


@query("""
with m as (select o_orderkey as b, o_custkey as u, unnest(case when o_orderkey % 3 = 0 then [] when o_orderkey % 3 = 1 then ['a'] else ['a', 'b'] end) as f from orders)
select o_custkey as person, 'all' as folder, count(*) as n from orders group by 1 union all select o_custkey, 'uncategorized', count_if(o_orderkey % 3 = 0)::bigint from orders group by 1 union all select u, f, count(*) from m group by all
""")
def a21_folder_counts(spark, t):
    """Bookmarks of everyone in all, without a folder, and in each folder."""
    k = F.col("o_orderkey") % 3
    folders = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return sections.folder_counts(t("orders").select(F.col("o_custkey").alias("person"), folders.alias("folders")), "person", "folders")


@query("select l_suppkey, count(distinct l_orderkey) as sections, count(*) as meetings, count_if(l_discount > 0.05)::bigint as located from lineitem group by 1")
def a25_contribution_counts(spark, t):
    s = t("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("m"), F.count_if(F.col("l_discount") > 0.05).alias("p"))
    return s.groupBy("l_suppkey").agg(F.count("*").alias("sections"), F.sum("m").alias("meetings"), F.sum("p").alias("located"))


@query("select o_orderkey, coalesce(list(l_suppkey order by l_linenumber, l_suppkey, l_partkey) filter (where l_suppkey is not null), []) as instructors from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def j2_ordered_embed(spark, t):
    """Every section with its instructors in their order; none is an empty list."""
    kids = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: x.l_suppkey).alias("instructors"))
    return t("orders").select("o_orderkey").join(kids, "o_orderkey", "left").withColumn("instructors", F.coalesce("instructors", F.array().cast("array<bigint>")))


@query("select a.l_orderkey, a.l_linenumber from lineitem a join (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag from lineitem where l_quantity > 25) b using (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag)")
def j10_identity_join(spark, t):
    """Staged rows meet stored ones by five columns."""
    on = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    l = t("lineitem")
    return l.join(l.where("l_quantity > 25").select(*on).distinct(), on).select("l_orderkey", "l_linenumber")


@query("""
with b as (select r_regionkey as pos, lower(r_name) as name from region), q as (select n_nationkey, lower(case n_nationkey % 4 when 0 then 'asia' when 1 then 'the america hall' when 2 then 'euro' else 'x' end) as text from nation),
h as (select n_nationkey, pos, case when text = name then 0 when contains(text, name) or contains(name, text) then 1 end as pass from q, b)
select n_nationkey, arg_min(pos, (pass, pos))::bigint as building from h where pass is not null group by 1
""")
def j22_contains_both_ways(spark, t):
    """A written place meets a building by name, else by either containing the other; the first wins."""
    k = F.col("n_nationkey") % 4
    text = F.when(k == 0, "asia").when(k == 1, "the america hall").when(k == 2, "euro").otherwise("x")
    return sections.contained_match(t("nation").select("n_nationkey", text.alias("text")), t("region").select(F.col("r_regionkey").cast("long").alias("building"), F.lower("r_name").alias("name")), "n_nationkey")


@query("select o_custkey, list(distinct year(o_orderdate)::bigint order by year(o_orderdate)::bigint) as terms from orders where year(o_orderdate) in (1996, 1998) group by 1")
def h4_across_terms(spark, t):
    at = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    d = F.col("o_orderdate")
    o = t("orders").where(((d >= at(1996)) & (d < at(1997))) | ((d >= at(1998)) & (d < at(1999)))).select("o_custkey", F.year(d).cast("long").alias("y"))
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("y")).alias("terms"))


@query("select c_custkey from customer where trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') = 'customer-000000042'")
def h5_by_slug(spark, t):
    return t("customer").where(slug(F.col("c_name")) == "customer-000000042").select("c_custkey")


@query("select s_suppkey, s_name from supplier where contains(lower(s_name), '00007')")
def h7_by_part_of_name(spark, t):
    return t("supplier").where(F.lower("s_name").contains("00007")).select("s_suppkey", "s_name")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by floor(o_totalprice / 50000) desc, o_orderkey) as r from orders) where r = 1")
def w8_first_best(spark, t):
    """The best of several; of equals the first."""
    best = F.floor(F.col("o_totalprice") / 50000)
    return relational.latest_per_key(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [best.desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
