"""Queries of merges and sinks (K) and of quality gates (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.operators import merge, relational
from lumenforge.plans.registry import query

_OLD = "(select o_orderkey as k, o_orderstatus as status, o_totalprice as price, case when o_orderkey % 4 > 0 then o_orderpriority end as note from orders where o_orderkey % 3 > 0)"
_NEW = "(select o_orderkey as k, case when o_orderkey % 5 > 0 then 'N' end as status, case when o_orderkey % 7 > 0 then o_totalprice + 1 end as price, o_orderpriority || '!' as note from orders where o_orderkey % 2 = 0)"


def _sides(t):
    o, k = t("orders"), F.col("o_orderkey")
    old = o.where(k % 3 > 0).select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("note"))
    new = o.where(k % 2 == 0).select(k.alias("k"), F.when(k % 5 > 0, "N").alias("status"), F.when(k % 7 > 0, F.col("o_totalprice") + 1).alias("price"), F.concat("o_orderpriority", F.lit("!")).alias("note"))
    return old, new


@query(f"""
select coalesce(o.k, n.k) as k, case when n.k is not null then n.status else o.status end as status, coalesce(n.price, o.price) as price, coalesce(o.note, n.note) as note from {_OLD} o full join {_NEW} n on o.k = n.k
""")
def k1_policy_merge(spark, t):
    old, new = _sides(t)
    return merge.merge(old, new, ["k"], {"status": "overwrite", "price": "coalesce", "note": "fill"})


@query(f"select o.k, coalesce(n.status, o.status) as status, coalesce(n.price, o.price) as price, coalesce(n.note, o.note) as note from {_OLD} o left join {_NEW} n on o.k = n.k")
def k2_detail_merge(spark, t):
    old, new = _sides(t)
    return merge.merge(old, new, ["k"], dict.fromkeys(("status", "price", "note"), "coalesce"), insert=False)


@query(f"select n.* from {_NEW} n left join {_OLD} o on o.k = n.k where o.k is null or o.status is distinct from n.status or o.price is distinct from n.price")
def k4_changed_only(spark, t):
    old, new = _sides(t)
    return merge.changed_rows(old, new, ["k"], ["status", "price"])


@query("""
select l_orderkey, l_partkey, 'new' as origin from lineitem where l_orderkey % 3 = 0 and l_quantity > 25
union all select l_orderkey, l_partkey, 'old' from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_orderkey % 3 = 0 and l_quantity > 25)
""")
def k3_replaced_children(spark, t):
    l = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    new = l.where("l_orderkey % 3 = 0 and l_quantity > 25").withColumn("origin", F.lit("new"))
    return merge.replace_children(l.withColumn("origin", F.lit("old")), new, ["l_orderkey"]).drop("l_quantity")


@query("select k, min(origin) as origin from (select c_custkey as k, 'a' as origin from customer where c_custkey % 2 = 0 union all select distinct o_custkey, 'b' from orders) group by 1")
def k22_insert_ignore(spark, t):
    old = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("a").alias("origin"))
    new = t("orders").select(F.col("o_custkey").alias("k"), F.lit("b").alias("origin"))
    return merge.insert_ignore(old, new, ["k"])


@query("select event_id from events where ts >= timestamp '2024-01-30 23:59:59' - interval 7 days")
def k23_retention(spark, t):
    return t("events").where(F.col("ts") >= F.lit("2024-01-30 23:59:59").cast("timestamp_ntz") - F.expr("interval 7 days")).select("event_id")


@query("""
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by (o_orderstatus = 'P') desc, o_orderdate, o_orderkey) = 1 as is_primary from orders
""")
def k17_single_primary(spark, t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "P"), "o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) == 1).alias("is_primary"))


@query("""
select user_id, list_sort(list(distinct event_type)) as kinds, max(value) as best from events where value between 0 and 300 group by 1
""")
def k18_profile_merge(spark, t):
    e = t("events").where("value between 0 and 300")
    a = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.max("value").alias("best"))
    b = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.max("value").alias("b"))
    m = merge.merge(a, b.withColumnRenamed("b", "best"), ["user_id"], {"kinds": "union"})
    best = e.groupBy("user_id").agg(F.max("value").alias("best"))
    return m.join(best, "user_id")


@query("select o_orderkey, coalesce(case when o_orderkey % 3 > 0 then o_totalprice end, m.lo) as price from orders left join (select l_orderkey, min(l_extendedprice) filter (where l_quantity > 10) as lo from lineitem group by 1) m on m.l_orderkey = o_orderkey")
def k19_backfill(spark, t):
    m = t("lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_quantity") > 10, F.col("l_extendedprice"))).alias("lo"))
    price = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))
    return t("orders").join(m, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce(price, "lo").alias("price"))


@query("select p_partkey, case when lower(trim(v)) <> 'to be announced' then v end as v from (select p_partkey, case when p_size % 9 = 0 then ' To Be Announced' else p_type end as v from part)")
def k20_announced_later(spark, t):
    v = F.when(F.col("p_size") % 9 == 0, " To Be Announced").otherwise(F.col("p_type"))
    return t("part").select("p_partkey", F.when(F.lower(F.trim(v)) != "to be announced", v).alias("v"))


@query("""
select o_orderkey, 'BEGIN:VEVENT|UID:' || o_orderkey || '|DTSTART:' || strftime(o_orderdate + interval 1 day * ((n.target - dayofweek(o_orderdate) + 7) % 7), '%Y%m%d') || 'T090000|RRULE:FREQ=WEEKLY;UNTIL=' || strftime(o_orderdate + interval 90 days, '%Y%m%d') || 'T235959|END:VEVENT' as ics
from orders, lateral (select o_orderkey % 7 as target) n
""")
def k26_ics_lines(spark, t):
    d = F.col("o_orderdate").cast("date")
    ahead = ((F.col("o_orderkey") % 7 - (F.dayofweek(d) - 1) + 7) % 7).cast("int")
    day = lambda x: F.date_format(x, "yyyyMMdd")
    ics = F.concat(F.lit("BEGIN:VEVENT|UID:"), F.col("o_orderkey").cast("string"), F.lit("|DTSTART:"), day(F.date_add(d, ahead)), F.lit("T090000|RRULE:FREQ=WEEKLY;UNTIL="), day(F.date_add(d, 90)), F.lit("T235959|END:VEVENT"))
    return t("orders").select("o_orderkey", ics.alias("ics"))


@query("select o_custkey, '[' || string_agg('{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' order by o_orderkey) || ']' as plans from orders group by 1")
def k29_json_tree(spark, t):
    s = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return t("orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(s))).alias("plans"))


@query("select o_orderkey from orders where o_custkey = 77 or exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = 3)")
def k30_row_filter(spark, t):
    c = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("mine"))
    return t("orders").join(c, "o_custkey", "left").where("o_custkey = 77 or mine = 1").select("o_orderkey")


@query("""
with d as (select date_trunc('day', ts) as day, count(*) as n, count(*) filter (where value > 20) as filled from events group by 1), p as (select *, lag(n) over (order by day) as pn, lag(filled) over (order by day) as pf from d)
select day, n, case when pn is null then 'ok' when n < pn then 'fewer records' when filled < floor(pf * 0.98) then 'fewer fields' else 'ok' end as verdict from p
""")
def q1_quarantine(spark, t):
    d = t("events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("filled"))
    w = Window.orderBy("day")  # one row a day
    pn, pf = F.lag("n").over(w), F.lag("filled").over(w)
    return d.select("day", "n", F.when(pn.isNull(), "ok").when(F.col("n") < pn, "fewer records").when(F.col("filled") < F.floor(pf * 0.98), "fewer fields").otherwise("ok").alias("verdict"))


@query("""
with a as (select o_custkey, count(*) as n from orders where o_orderdate < timestamp '1998-06-01' group by 1), b as (select o_custkey, count(*) as n from orders where o_orderdate >= timestamp '1998-06-01' group by 1)
select o_custkey, case when coalesce(b.n, 0) = 0 then 'rejected' when a.n > 3 and b.n < a.n * 0.7 then 'rejected' when b.n < a.n then 'partial' else 'accepted' end as status from a left join b using (o_custkey)
""")
def q3_contribution_status(spark, t):
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    o = t("orders")
    n = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") < cut).alias("a"), F.count_if(F.col("o_orderdate") >= cut).alias("b")).where("a > 0")
    status = F.when(F.col("b") == 0, "rejected").when((F.col("a") > 3) & (F.col("b") < F.col("a") * 0.7), "rejected").when(F.col("b") < F.col("a"), "partial").otherwise("accepted")
    return n.select("o_custkey", status.alias("status"))


@query("select l_orderkey, l_linenumber from lineitem group by all having count(distinct l_partkey) > 1")
def q4_conflicting_payloads(spark, t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count_distinct("l_partkey").alias("n")).where("n > 1").drop("n")


@query("""
select l_orderkey, max_by(l_partkey, (10 * (l_quantity > 20)::bigint + 2 * (l_discount > 0.05)::bigint + (l_tax > 0.04)::bigint, l_partkey)) as kept from lineitem group by 1
""")
def q6_best_by_quality(spark, t):
    quality = 10 * (F.col("l_quantity") > 20).cast("long") + 2 * (F.col("l_discount") > 0.05).cast("long") + (F.col("l_tax") > 0.04).cast("long")
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(quality, F.col("l_partkey"))).alias("kept"))


@query("select p_type, min(p_partkey) as p_partkey from part where p_size % 10 = 0 group by 1")
def q8_one_page_each(spark, t):
    return relational.latest_per_key(t("part").where("p_size % 10 = 0").select("p_type", "p_partkey"), ["p_type"], [F.col("p_partkey")])


@query("""
select page_id, case when html is null or length(html) < 200 then 'too short' when contains(html, 'no longer offered') then 'tombstone' when not contains(html, '<article') then 'parse error' else 'ok' end as outcome from pages
""")
def q7_ingest_outcome(spark, t):
    h = F.col("html")
    return t("pages").select("page_id", F.when(h.isNull() | (F.length(h) < 200), "too short").when(h.contains("no longer offered"), "tombstone").when(~h.contains("<article"), "parse error").otherwise("ok").alias("outcome"))
