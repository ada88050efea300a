"""Queries of writers and checks (K5, K6, K7, K9, K14, K16, K24, Q2) on stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.operators import merge, writers
from lumenforge.plans.registry import query


def _long(x):
    return F.lit(x).cast("long")


@query("""
with o as (select p_brand as code, max(p_name) as name from part where p_size <= 25 group by 1), n as (select p_brand as code, max(p_type) as name from part where p_size > 10 and regexp_full_match(p_brand, 'Brand#[0-9]{1,2}') group by 1)
select coalesce(o.code, n.code) as code, coalesce(n.name, o.name) as name from o full join n on o.code = n.code
""")
def k5_subject_upsert(spark, t):
    """Subjects with valid codes go in; others are skipped."""
    old = t("part").where("p_size <= 25").groupBy(F.col("p_brand").alias("code")).agg(F.max("p_name").alias("name"))
    new = t("part").where("p_size > 10").where(F.col("p_brand").rlike("^Brand#[0-9]{1,2}$")).groupBy(F.col("p_brand").alias("code")).agg(F.max("p_type").alias("name"))
    return merge.merge(old, new, ["code"], {"name": "coalesce"})


@query("""
with b as (select n_nationkey as term, 10 as starts, 100 as ends from nation), n as (select c_nationkey as term, min(floor(c_acctbal))::bigint as starts, max(floor(c_acctbal))::bigint as ends from customer where c_custkey % 2 = 0 group by 1)
select b.term::bigint as term, coalesce(case when n.ends >= n.starts then n.starts end, b.starts)::bigint as starts, coalesce(case when n.ends >= n.starts then n.ends end, b.ends)::bigint as ends,
 coalesce(n.ends >= n.starts and (n.starts is distinct from b.starts or n.ends is distinct from b.ends), false) as changed from b left join n on n.term = b.term
""")
def k6_term_bounds(spark, t):
    """A term takes the bounds of its calendar where they are in order and differ."""
    old = t("nation").select(F.col("n_nationkey").cast("long").alias("term"), _long(10).alias("starts"), _long(100).alias("ends"))
    new = t("customer").where("c_custkey % 2 = 0").groupBy(F.col("c_nationkey").cast("long").alias("term")).agg(F.min(F.floor("c_acctbal")).alias("starts"), F.max(F.floor("c_acctbal")).alias("ends"))
    new = new.where("ends >= starts")
    differ = merge.changed_rows(old, new, ["term"], ["starts", "ends"]).select("term", F.lit(True).alias("changed"))
    out = merge.merge(old, new, ["term"], {"starts": "coalesce", "ends": "coalesce"}, insert=False)
    return out.join(differ, "term", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("""
select (year(o_orderdate) * 10 + quarter(o_orderdate))::varchar as term, year(min(o_orderdate))::bigint as year, case substr((year(o_orderdate) * 10 + quarter(o_orderdate))::varchar, 5, 1) when '1' then 'spring' when '2' then 'summer' when '3' then 'fall' else 'other' end as season
from orders group by all
""")
def k7_ensured_terms(spark, t):
    """Terms seen, once each, with the season that the fifth digit names."""
    term = (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("string")
    fifth = F.substring("term", 5, 1)
    season = F.when(fifth == "1", "spring").when(fifth == "2", "summer").when(fifth == "3", "fall").otherwise("other")
    return t("orders").select(term.alias("term")).distinct().select("term", F.substring("term", 1, 4).cast("long").alias("year"), season.alias("season"))


@query("""
select o_orderkey, case when o_orderkey % 10 = 0 then timestamp '2020-01-01' when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then timestamp '2024-01-31' end as withdrawn_at from orders
""")
def k9_soft_delete(spark, t):
    """What is gone is stamped, once; readers filter by the stamp."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, at("2020-01-01")).alias("withdrawn_at"))
    gone = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return writers.soft_deleted(rows, gone, ["o_orderkey"], "withdrawn_at", at("2024-01-31"))


@query("""
with r as (select user_id, ts, max(value) as value from events where event_type <> 'signup' group by all)
select e.event_id, e.user_id, r.value as baseline from (select * from events where event_type = 'signup') e asof left join r on r.user_id = e.user_id and r.ts <= e.ts
""")
def k14_stamped_baseline(spark, t):
    """A watch takes the last reading at its time as its baseline."""
    e = t("events")
    readings = e.where("event_type <> 'signup'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    watches = e.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return writers.stamped_from_last(watches, readings, "user_id", "ts", "value", "baseline").select("event_id", "user_id", "baseline")


@query("""
with p as (select o_custkey, o_orderkey as plan, o_orderdate as created, o_orderstatus = 'P' as flagged, l_partkey as section, l_linenumber as pos, (l_quantity * 40 - 300)::bigint as s, (l_quantity * 50)::bigint as e from orders join lineitem on l_orderkey = o_orderkey where l_partkey in (select p_partkey from part where p_type <> 'PROMO')),
f as (select o_custkey, arg_min(plan, (case when flagged then 0 else 1 end, created, plan)) as main from p group by 1)
select o_custkey, plan, section, row_number() over (partition by o_custkey, plan order by pos, section, s, e) - 1 as position, greatest(0, least(1440, s)) as start, greatest(0, least(1440, e)) as "end", plan = main as is_primary from p join f using (o_custkey)
""")
def k16_replaced_plans(spark, t):
    """Plans as sent: unknown sections dropped, positions renumbered, minutes held to the day, one primary."""
    lines = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    plans = lines.select("o_custkey", F.col("o_orderkey").alias("plan"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "P").alias("flagged"), F.col("l_partkey").alias("section"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") * 40 - 300).cast("long").alias("start"), (F.col("l_quantity") * 50).cast("long").alias("end"))
    return writers.replaced_plans(plans, t("part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("section")), "o_custkey")


@query("""
with m as (select o_orderkey as bookmark, o_custkey as folder from orders), g as (select c_custkey as folder from customer where c_mktsegment = 'BUILDING' or c_custkey % 4 = 0)
select bookmark from m where folder not in (select folder from g)
""")
def k24_folder_deleted(spark, t):
    """Bookmarks left when folders go with what lies in them."""
    members = t("orders").select(F.col("o_orderkey").alias("bookmark"), F.col("o_custkey").alias("folder"))
    folders = t("customer").where("c_mktsegment = 'BUILDING' or c_custkey % 4 = 0").select(F.col("c_custkey").alias("folder"))
    return writers.folder_deleted(members, folders, members.select("bookmark"), True)[1]


_RUNS = "(select l_partkey as k, count(*) - 6 * (l_partkey % 11 = 0)::bigint as records, count(*) filter (where l_returnflag <> 'N') as filled from lineitem where l_shipdate {} timestamp '1999-01-01' group by 1)"


@query(f"""
select n.k, n.records, n.filled, case when n.records < 0 or n.filled > n.records or coalesce(p.records < 0 or p.filled > p.records, false) then 'incoherent' when p.k is null or p.records = 0 then null when n.records = 0 then 'empty'
 when p.records > 3 and (p.records - n.records) / p.records::double > 0.3 then 'records' when p.filled > 3 and (p.filled - n.filled) / p.filled::double > 0.5 then 'filled' when p.filled > 0 and n.filled = 0 then 'all filled lost' end as reason
from {_RUNS.format('>=')} n left join {_RUNS.format('<')} p on p.k = n.k
""")
def q2_quarantined_runs(spark, t):
    """Runs that lost too much, with the reason."""
    edge = F.lit("1999-01-01").cast("timestamp_ntz")
    run = lambda rows: rows.groupBy(F.col("l_partkey").alias("k")).agg((F.count("*") - F.when(F.col("l_partkey") % 11 == 0, 6).otherwise(0)).alias("records"), F.count_if(F.col("l_returnflag") != "N").alias("filled"))
    l = t("lineitem")
    return writers.quarantined(run(l.where(F.col("l_shipdate") >= edge)), run(l.where(F.col("l_shipdate") < edge)), ["k"])
