"""Aggregation queries (A) and orders with limits (O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.functions.scalar import recency_weight, round_half_up
from lumenforge.operators import relational, schedule
from lumenforge.plans.joins import MINUTES, minutes
from lumenforge.plans.registry import query

NOW = "2001-09-01"


@query("""
select source, count(*) as n, round(avg(quality) * 5, 6) as quality_5, round(avg(case when toxic is not null then toxic end), 6) as toxic_rate, min(d.doc_id) as first_id, max(d.doc_id) as last_id,
       count(*) filter (where lang = 'en') as n_en, count(quality) as n_rated
from documents d left join labels l on l.doc_id = d.doc_id group by 1
""")
def a1_reputation(spark, t):
    d = t("documents").select("doc_id", "source", "lang").join(t("labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality") * 5, 6).alias("quality_5"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count("quality").alias("n_rated"))


@query(f"""
select o_orderpriority as tier, count(*) as total, count(*) filter (where o_orderdate <= timestamp '{NOW}') as due, count(*) filter (where o_orderdate < timestamp '{NOW}' - interval 365 days) as overdue, count(*) filter (where o_orderstatus = 'F') as failing from orders group by 1
""")
def a2_queue_health(spark, t):
    now = F.lit(NOW).cast("timestamp_ntz")
    d = F.col("o_orderdate")
    return t("orders").groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("total"), F.count_if(d <= now).alias("due"), F.count_if(d < now - F.expr("interval 365 days")).alias("overdue"), F.count_if(F.col("o_orderstatus") == "F").alias("failing"))


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by 1")
def a3_dense_counts(spark, t):
    o = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.dense_counts(t("customer"), o, "c_custkey")


@query("select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1")
def a3_sparse_counts(spark, t):
    return t("orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""
with w as (select user_id, min_by(value, (ts, event_id)) as base, max_by(value, (ts, event_id)) as now from events group by 1)
select user_id, round(now - base, 6) as delta from w
""")
def a4_watch_delta(spark, t):
    at = F.struct("ts", "event_id")
    return t("events").groupBy("user_id").agg(F.round(F.max_by("value", at) - F.min_by("value", at), 6).alias("delta"))


@query(f"""
with r as (select c_nationkey, o_totalprice / 100000 as rating, case when o_orderstatus = 'P' then null else o_orderstatus = 'O' end as again, date_diff('day', o_orderdate::date, date '{NOW}')::double as age from orders join customer on c_custkey = o_custkey),
w as (select *, case when age <= 0 then 1.0 else greatest(0.05, floor(power(0.5, age / 730.0) * 1000000 + 0.5) / 1000000) end as w from r)
select c_nationkey, floor(sum(rating * w) / sum(w) * 100 + 0.5) / 100 as mean, sum(case when again then w else 0 end) / sum(case when again is not null then w end) >= 0.5 as take_again, count(*) as n from w group by 1
""")
def a5_recency_weighted(spark, t):
    age = F.datediff(F.lit(NOW).cast("date"), "o_orderdate").cast("double")
    r = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("w", recency_weight(age, 730.0))
    w, again = F.col("w"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O")
    mean = F.sum(F.col("o_totalprice") / 100000 * w) / F.sum(w)
    share = F.sum(F.when(again, w).otherwise(0.0)) / F.sum(F.when(again.isNotNull(), w))
    return r.groupBy("c_nationkey").agg(round_half_up(mean, 2).alias("mean"), (share >= 0.5).alias("take_again"), F.count("*").alias("n"))


@query("""
with d as (select l_suppkey, avg(case when l_returnflag = 'R' then l_quantity end) / 10 as a, avg(case when l_returnflag = 'A' then l_quantity end) / 10 as b, avg(case when l_tax > 0.07 then l_quantity end) / 10 as c from lineitem group by 1)
select l_suppkey, floor(100 * (1 + 4 * ((coalesce(0.5 * (a - 1) / 4, 0) + coalesce(0.25 * (b - 1) / 4, 0) + coalesce(0.25 * (c - 1) / 4, 0)) / (case when a is null then 0 else 0.5 end + case when b is null then 0 else 0.25 end + case when c is null then 0 else 0.25 end))) + 0.5) / 100 as composite
from d where coalesce(a, b, c) is not null
""")
def a6_composite(spark, t):
    q = F.col("l_quantity")
    d = t("lineitem").groupBy("l_suppkey").agg(*[(F.avg(F.when(c, q)) / 10).alias(n) for n, c in (("a", F.col("l_returnflag") == "R"), ("b", F.col("l_returnflag") == "A"), ("c", F.col("l_tax") > 0.07))])
    parts = [("a", 0.5), ("b", 0.25), ("c", 0.25)]
    total = sum((F.coalesce(w * (F.col(n) - 1) / 4, F.lit(0.0)) for n, w in parts), F.lit(0.0))
    weight = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in parts), F.lit(0.0))
    return d.where("coalesce(a, b, c) is not null").select("l_suppkey", round_half_up(1 + 4 * (total / weight), 2).alias("composite"))


@query("select lang, count(*) filter (where source = 'src0') as src0, count(*) filter (where source = 'src1') as src1, count(*) filter (where source = 'none') as none from documents group by 1")
def a7_counts_by_source(spark, t):
    out = t("documents").groupBy("lang").pivot("source", ["src0", "src1", "none"]).agg(F.count("doc_id"))
    return out.na.fill(0)


@query("select c_mktsegment, count(distinct c_nationkey) as nations, count(distinct o_custkey) as buyers, min(o_totalprice) as low, max(o_totalprice) as high from customer join orders on o_custkey = c_custkey group by 1")
def a9_facet_counts(spark, t):
    j = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("nations"), F.count_distinct("o_custkey").alias("buyers"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("""
select l_suppkey, sum(l_quantity) as quantity, round(sum(l_quantity) / 5000, 6) as fill, list_sort(list(distinct l_linestatus)) as statuses, max_by(l_orderkey, (l_extendedprice, l_orderkey)) as largest, min(l_shipdate) as oldest, count(distinct l_partkey) as parts from lineitem group by 1
""")
def a11_profile(spark, t):
    q = F.sum("l_quantity")
    return t("lineitem").groupBy("l_suppkey").agg(q.alias("quantity"), F.round(q / 5000, 6).alias("fill"), F.sort_array(F.collect_set("l_linestatus")).alias("statuses"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("largest"), F.min("l_shipdate").alias("oldest"), F.count_distinct("l_partkey").alias("parts"))


@query("""
select y as term, count(o_orderkey) as n from (select unnest([1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002])::bigint as y) left join orders on year(o_orderdate) = y group by 1
""")
def a13_dense_terms(spark, t):
    terms = spark.range(1994, 2003).withColumnRenamed("id", "term")
    n = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("term")).agg(F.count("*").alias("n"))
    return terms.join(n, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


@query("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand")
def a14_by_frequency(spark, t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("select c_nationkey, round(sum(coalesce(v, c_acctbal, 0)), 2) as total from customer left join (select user_id, max(value) as v from events group by 1) on user_id = c_custkey group by 1")
def a15_fallback_totals(spark, t):
    v = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("v"))
    return t("customer").join(v, "c_custkey", "left").groupBy("c_nationkey").agg(F.round(F.sum(F.coalesce("v", "c_acctbal", F.lit(0.0))), 2).alias("total"))


@query("""
with d as (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as day), u as (select distinct user_id from events)
select user_id, count(*) as idle_days from u, d where not exists (select 1 from events e where e.user_id = u.user_id and cast(e.ts as date) = d.day) group by 1
""")
def a17_days_without(spark, t):
    return schedule.idle_days(t("events"), "user_id", F.col("ts").cast("date"), "2024-01-01", "2024-01-30").where("idle_days > 0")


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1")
def a19_duplicates(spark, t):
    return t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query(f"with i as ({MINUTES}) select user_id, s, list_sort(list(distinct dayofweek(day)::bigint)) as days from i group by all")
def a22_day_patterns(spark, t):
    return minutes(t).groupBy("user_id", "s").agg(F.sort_array(F.collect_set((F.dayofweek("day") - 1).cast("long"))).alias("days"))


@query("select l_orderkey, bit_or(case l_returnflag when 'R' then 1 when 'A' then 2 else 4 end)::bigint as mask, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem group by 1")
def a23_summary_masks(spark, t):
    bit = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4).cast("long")
    return t("lineitem").groupBy("l_orderkey").agg(F.bit_or(bit).alias("mask"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("select count(*) as records, (count(doc_id) + count(quality) + count(toxic))::bigint as filled from labels")
def a24_fingerprint(spark, t):
    return t("labels").agg(F.count("*").alias("records"), (F.count("doc_id") + F.count("quality") + F.count("toxic")).alias("filled"))


@query("select user_id, count(*) as used from events where ts >= timestamp '2024-01-20' and event_type <> 'error' group by 1")
def a26_used_in_window(spark, t):
    return t("events").where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") != "error")).groupBy("user_id").agg(F.count("*").alias("used"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def a27_percentiles(spark, t):
    return t("events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'F' qualify row_number() over (order by o_totalprice desc, o_orderkey) <= 20")
def o1_top_k_with_total(spark, t):
    f = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return f.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).join(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("""
select p_partkey, floor(p_retailprice / (top * 0.02))::bigint as band, row_number() over (order by floor(p_retailprice / (top * 0.02)) desc, p_size desc, p_retailprice desc, p_partkey) as place
from part, (select max(p_retailprice) as top from part) qualify place <= 30
""")
def o2_banded_order(spark, t):
    top = relational.banded_order(t("part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", "p_partkey").limit(30)
    w = Window.orderBy(F.desc("band"), F.desc("p_size"), F.desc("p_retailprice"), "p_partkey")
    return top.withColumn("place", F.row_number().over(w).cast("long")).select("p_partkey", "band", "place")


@query("select p_partkey, p_brand, row_number() over (order by regexp_extract(p_brand, '^[^0-9]*'), regexp_extract(p_brand, '[0-9]+')::bigint, p_partkey) as place from part qualify place <= 40")
def o6_natural_order(spark, t):
    keys = [F.regexp_extract("p_brand", "^[^0-9]*", 0), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long"), F.col("p_partkey")]
    top = t("part").select("p_partkey", "p_brand").orderBy(*keys).limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long"))


@query("""
select p_partkey, score from (select p_partkey, case when p_brand = 'Brand#7' then 100 - abs(p_size - 20) / 10.0 when p_type = 'PROMO' then 40 - abs(p_size - 20) / 100.0 else 20.0 + case when abs(p_size - 20) <= 2 then 25 else 0 end end as score from part) order by score desc, p_partkey limit 6
""")
def o7_similar_items(spark, t):
    d = F.abs(F.col("p_size") - 20)
    score = F.when(F.col("p_brand") == "Brand#7", 100 - d / 10.0).when(F.col("p_type") == "PROMO", 40 - d / 100.0).otherwise(20.0 + F.when(d <= 2, 25).otherwise(0))
    return t("part").select("p_partkey", score.cast("double").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(6)


@query()
def w4_lanes(spark, t):
    """Lanes of overlapping items; no SQL, a test holds it against brute force."""
    return schedule.lanes(minutes(t), ["user_id", "day"], "s", "e", "event_id")


@query(f"""
with i as ({MINUTES}), m as (select *, max(e) over (partition by user_id, day order by s, e, event_id rows between unbounded preceding and 1 preceding) as reach from i)
select event_id, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by user_id, day order by s, e, event_id rows unbounded preceding)::bigint as cluster from m
""")
def w4_overlap_clusters(spark, t):
    return schedule.clusters(minutes(t), ["user_id", "day"], "s", "e", "event_id").select("event_id", "cluster")
