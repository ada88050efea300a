"""Queries that join (J), union (U) and look up (S, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.functions.scalar import normalize_name, overlaps
from lumenforge.operators import graph, relational, schedule
from lumenforge.plans.registry import query

MINUTES = "select event_id, user_id, cast(ts as date) as day, hour(ts) * 60 + minute(ts) as s, hour(ts) * 60 + minute(ts) + 1 + floor(value)::bigint as e from events where value < 200"


def minutes(t):
    """Events as half-open intervals of minutes of a user's day."""
    s = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return t("events").where("value < 200").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), s.alias("s"), (s + 1 + F.floor("value")).alias("e"))


@query("""
select o_orderkey, o_custkey, count(*) as n_lines, list_sort(list(l_linenumber)) as lines from orders join lineitem on l_orderkey = o_orderkey where year(o_orderdate) = 1997 group by all
""")
def s1_term_scan(spark, t):
    o = t("orders").where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    mine = t("lineitem").select("l_orderkey", "l_linenumber").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    l = mine.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "n_lines", "lines")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def s2_listing_semijoin(spark, t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 77")
def s3_point_lookup(spark, t):
    return t("orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select pos, c_custkey, c_name from (select unnest([42, 7, 1001, 7, 3]) as id, unnest([0, 1, 2, 3, 4])::bigint as pos) join customer on c_custkey = id")
def s5_hydrated_in_order(spark, t):
    ids = spark.createDataFrame([(p, i) for p, i in enumerate([42, 7, 1001, 7, 3])], "pos long, c_custkey long")
    return t("customer").join(F.broadcast(ids), "c_custkey").select("pos", "c_custkey", "c_name").orderBy("pos")


@query("""
with a as (select c_custkey as id, c_name as name, [c_nationkey] as keys from customer where c_custkey % 3 > 0), b as (select c_custkey as id, null::varchar as name, [c_nationkey + 100] as keys from customer where c_custkey % 2 = 0)
select coalesce(a.id, b.id) as id, a.name, list_concat(coalesce(a.keys, []), coalesce(b.keys, [])) as keys from a full join b on a.id = b.id
""")
def s6_multi_term_merge(spark, t):
    c = t("customer")
    a = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_nationkey").alias("keys"))
    b = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"), F.array(F.col("c_nationkey") + 100).alias("keys"))
    return a.unionByName(b).groupBy("id").agg(F.first("name", ignorenulls=True).alias("name"), F.sort_array(F.flatten(F.collect_list("keys"))).alias("keys"))


@query("""
with src as (select * from orders where o_orderstatus = 'F'), j as (
 select t.o_orderkey, s.o_orderkey as src_key, row_number() over (partition by t.o_orderkey order by (quarter(s.o_orderdate) = quarter(t.o_orderdate)) desc, s.o_orderdate desc, s.o_orderkey desc) r
 from orders t join src s on s.o_custkey = t.o_custkey and s.o_orderdate < t.o_orderdate where t.o_orderstatus = 'P')
select o_orderkey, src_key from j where r = 1
""")
def j4_typical_asof(spark, t):
    o = t("orders")
    prefer = F.quarter("src_o_orderdate") == F.quarter("o_orderdate")
    out = relational.ranked_earlier(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderdate", prefer, ["o_orderkey"], "o_orderkey")
    return out.select("o_orderkey", F.col("src_o_orderkey").alias("src_key"))


@query("select s_suppkey, count(l_orderkey) as n, coalesce(sum(l_quantity), 0) as quantity from supplier left join lineitem on l_suppkey = s_suppkey and l_returnflag = 'R' group by 1")
def j8_lateral_aggregate(spark, t):
    l = t("lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return t("supplier").join(l, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def j6_anti(spark, t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def j9_json_rows(spark, t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
with exact as (select o_custkey, o_orderpriority, min(o_orderkey) as v from orders where o_orderstatus = 'P' group by all), loose as (select o_custkey, min(o_orderkey) as v from orders where o_orderstatus = 'F' group by all)
select o.o_orderkey, coalesce(e.v, l.v) as v from orders o left join exact e on e.o_custkey = o.o_custkey and e.o_orderpriority = o.o_orderpriority left join loose l on l.o_custkey = o.o_custkey where o.o_orderstatus = 'O'
""")
def j11_fallback_join(spark, t):
    o = t("orders")
    exact = o.where("o_orderstatus = 'P'").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("v"))
    loose = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("v"))
    return relational.fallback_join(o.where("o_orderstatus = 'O'"), exact, loose, ["o_custkey", "o_orderpriority"], ["o_custkey"], "v").select("o_orderkey", "v")


@query(f"""
with i as ({MINUTES}) select a.event_id, b.event_id as other_id from i a join i b on a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id and a.s < b.e and b.s < a.e
""")
def j13_interval_conflicts(spark, t):
    return relational.overlapping_pairs(minutes(t), ["user_id", "day"], "event_id", "s", "e", 120).select("event_id", "other_id")


@query(f"""
with i as ({MINUTES}) select event_id, exists (select 1 from i b where b.user_id = 7 and b.day = a.day and a.s < b.e and b.s < a.e) as conflict from i a where user_id <> 7
""")
def j14_conflict_flag(spark, t):
    i = minutes(t)
    busy = i.where("user_id = 7").select(F.col("day").alias("bd"), F.col("s").alias("bs"), F.col("e").alias("be"))
    hit = i.where("user_id <> 7").join(busy, (F.col("day") == F.col("bd")) & overlaps(F.col("s"), F.col("e"), F.col("bs"), F.col("be")), "left")
    return hit.groupBy("event_id").agg(F.max(F.col("bd").isNotNull()).alias("conflict"))


@query(f"""
with i as ({MINUTES}), g as (select unnest(range(0, 1440, 60)) as minute)
select dayofweek(day)::bigint as weekday, minute::bigint as minute, count(*)::bigint as load from i join g on s <= minute and minute < e group by all
""")
def j15_grid_load(spark, t):
    i = minutes(t).withColumn("weekday", (F.dayofweek("day") - 1).cast("long")).withColumn("one", F.lit(1).cast("long"))
    return schedule.grid_load(i, "weekday", "s", "e", "one")


@query("""
with d as (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day))::date as day)
select n_nationkey, d.day from nation join d on dayofweek(d.day) = n_nationkey % 7
""")
def j16_calendar_join(spark, t):
    n = t("nation").select("n_nationkey", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-31')")).alias("day"))
    return n.where((F.dayofweek("day") - 1) == F.col("n_nationkey") % 7)


@query("""
select e.event_id, coalesce(x.c_custkey, y.c_custkey) as c_custkey from events e left join customer x on x.c_custkey = e.user_id * 11
left join (select c_nationkey, min(c_custkey) as c_custkey from customer group by 1) y on y.c_nationkey = e.user_id % 25
""")
def j18_renumbered_lookup(spark, t):
    c = t("customer")
    exact = c.select((F.col("c_custkey")).alias("k1"), F.col("c_custkey").alias("a"))
    loose = c.groupBy(F.col("c_nationkey").cast("long").alias("k2")).agg(F.min("c_custkey").alias("b"))
    e = t("events").select("event_id", (F.col("user_id") * 11).alias("k1"), (F.col("user_id") % 25).alias("k2"))
    return e.join(exact, "k1", "left").join(loose, "k2", "left").select("event_id", F.coalesce("a", "b").alias("c_custkey"))


@query("select p_size, min(p_partkey) as p_partkey from part where p_brand = 'Brand#7' group by 1 having count(distinct p_partkey) = 1")
def j19_unambiguous_ids(spark, t):
    return relational.unique_lookup(t("part").where("p_brand = 'Brand#7'").select("p_size", "p_partkey"), "p_size", "p_partkey")


@query("""
with a as (select p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as k, p_brand from part), u as (select k, p_brand, min(p_partkey) as m from a group by all having count(*) = 1)
select a.p_partkey, u.m as matched from a join u on u.k = a.k and u.p_brand = a.p_brand
""")
def j20_unique_name_match(spark, t):
    a = t("part").select("p_partkey", normalize_name(F.col("p_name")).alias("k"), "p_brand")
    u = a.groupBy("k", "p_brand").agg(F.min("p_partkey").alias("matched"), F.count("*").alias("n")).where("n = 1").drop("n")
    return a.join(u, ["k", "p_brand"]).select("p_partkey", "matched")


@query("""
with al as (select unnest(['small ring', 'small', 'ring', 'widget', 'red widget']) as alias),
m as (select p_partkey, alias, case when p_name = alias then 3000 when starts_with(p_name, alias) or ends_with(p_name, alias) then 2000 when contains(p_name, alias) then 1000 end + length(alias) as score from part, al where contains(p_name, alias))
select p_partkey, alias, score::bigint as score from (select *, row_number() over (partition by p_partkey order by score desc, alias) r from m) where r = 1
""")
def j21_alias_match(spark, t):
    al = spark.createDataFrame([(x,) for x in ("small ring", "small", "ring", "widget", "red widget")], "alias string")
    p, a = F.col("p_name"), F.col("alias")
    score = F.when(p == a, 3000).when(p.startswith(a) | p.endswith(a), 2000).otherwise(1000) + F.length(a)
    m = t("part").join(F.broadcast(al), p.contains(a)).select("p_partkey", "alias", score.cast("long").alias("score"))
    return relational.latest_per_key(m, ["p_partkey"], [F.desc("score"), F.col("alias")])


@query(f"""
with i as ({MINUTES}), n as (select *, lead(event_id) over w as nx, lead(s) over w as ns from i window w as (partition by user_id, day order by s, e, event_id))
select event_id, nx as next_event_id, ns - e as gap from n where nx is not null
""")
def j23_consecutive_items(spark, t):
    n = schedule.consecutive(minutes(t), ["user_id", "day"], ["s", "e", "event_id"], ["event_id", "s"])
    return n.select("event_id", "next_event_id", (F.col("next_s") - F.col("e")).alias("gap"))


@query("""
with sel as (select * from (values (1, 'Brand#7', 10, 20, 'PROMO'), (2, 'Brand#9', 1, 50, null), (3, null, 45, 50, 'SMALL')) v(sid, brand, lo, hi, kind))
select sid::bigint as sid, p_partkey from part, sel where (brand is null or p_brand = brand) and p_size between lo and hi and (kind is null or p_type = kind)
""")
def j24_selector_candidates(spark, t):
    sel = spark.createDataFrame([(1, "Brand#7", 10, 20, "PROMO"), (2, "Brand#9", 1, 50, None), (3, None, 45, 50, "SMALL")], "sid long, brand string, lo int, hi int, kind string")
    fit = (F.col("brand").isNull() | (F.col("p_brand") == F.col("brand"))) & F.col("p_size").between(F.col("lo"), F.col("hi")) & (F.col("kind").isNull() | (F.col("p_type") == F.col("kind")))
    return t("part").join(F.broadcast(sel), fit).select("sid", "p_partkey")


@query("select c_custkey from customer where c_mktsegment = 'MACHINERY' except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def u4_difference(spark, t):
    have = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey").distinct().join(have, "c_custkey", "left_anti")


@query("""
select c_custkey from customer where c_acctbal > 9000 union select o_custkey from orders where o_totalprice > 450000 union select user_id from events where event_type = 'purchase'
""")
def u5_three_pools(spark, t):
    a = t("customer").where("c_acctbal > 9000").select("c_custkey")
    b = t("orders").where("o_totalprice > 450000").select("o_custkey")
    return a.union(b).union(t("events").where("event_type = 'purchase'").select("user_id")).distinct()


@query("""
with recursive e as (select p_partkey as a, p_partkey + 1 + p_size as b from part where p_size <= 3), s as (select a as u, b as v from e union select b, a from e), r as (select u as node, u as reach from s union select r.node, s.v from r join s on s.u = r.reach)
select node, min(reach) as component from r group by 1
""")
def u6_merged_sets(spark, t):
    e = t("part").where("p_size <= 3").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size")).alias("b"))
    return graph.min_label_components(e, "a", "b")


@query("select o_custkey, list_sort(list(distinct o_orderpriority)) as priorities from orders group by 1")
def u3_array_union(spark, t):
    return t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


@query("select c_custkey, c_name from customer where c_name like 'Customer#00000004%'")
def h8_prefix_filter(spark, t):
    return t("customer").where(F.col("c_name").startswith("Customer#00000004")).select("c_custkey", "c_name")


@query("select distinct p_brand from part order by 1")
def h6_distinct_dimensions(spark, t):
    return t("part").select("p_brand").distinct().orderBy("p_brand")


@query("""
select p.p_partkey, p.p_name from part p where p.p_brand = 'Brand#7' or p.p_type = 'PROMO'
""")
def h2_candidate_union(spark, t):
    return t("part").where((F.col("p_brand") == "Brand#7") | (F.col("p_type") == "PROMO")).select("p_partkey", "p_name")


@query("""
select distinct o_orderkey, s_suppkey from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where s_name = 'Supplier#000000007' and year(o_orderdate) = 1998
""")
def h3_bridge_join(spark, t):
    s = t("supplier").where("s_name = 'Supplier#000000007'").select("s_suppkey")
    o = t("orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))).select("o_orderkey")
    l = t("lineitem").select("l_orderkey", "l_suppkey").join(F.broadcast(s), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "s_suppkey").distinct()


@query(f"with i as ({MINUTES}) select event_id, exists (select 1 from i b where b.user_id = a.user_id and b.day = a.day and b.event_id <> a.event_id and a.s < b.e and b.s < a.e) as conflicted from i a")
def h10_marked_conflicts(spark, t):
    i = minutes(t)
    pairs = relational.overlapping_pairs(i, ["user_id", "day"], "event_id", "s", "e", 120)
    marked = pairs.select("event_id").union(pairs.select("other_id")).distinct().withColumn("hit", F.lit(True))
    return i.join(marked, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("conflicted"))
