"""Queries over time series of readings (T, W, K10, K15, U1-U2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.functions.scalar import recency_weight, round_half_up
from lumenforge.operators import history, relational, windows
from lumenforge.plans.registry import query

SINCE = "2024-01-10 00:00:00"


@query(f"""
with s as (select *, coalesce(value >= 100, false) as o, lag(coalesce(value >= 100, false)) over (partition by user_id order by ts, event_id) as was from events)
select event_id, ts, user_id, event_type, value, greatest(500 - value, 0) as seats_open from s
where o and not was and ts >= timestamp '{SINCE}'
""")
def t1_open_transitions(spark, t):
    out = history.open_transitions(t("events").drop("props"), "user_id", "ts", "event_id", F.col("value") >= 100, SINCE)
    return out.withColumn("seats_open", F.greatest(500 - F.col("value"), F.lit(0.0)))


@query("""
with s as (select event_id, user_id, ts, event_type, lag(event_type) over w as p, row_number() over w as r from events window w as (partition by user_id order by ts, event_id))
select event_id, user_id, ts, event_type from s where r = 1 or event_type is distinct from p
""")
def t2_changed_readings(spark, t):
    return history.changed_readings(t("events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", ["event_type"])


@query(f"""
select event_id, user_id, ts, value from events where ts >= timestamp '{SINCE}'
union all
select event_id, user_id, ts, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events where ts < timestamp '{SINCE}') where r = 1
""")
def t3_left_edge(spark, t):
    return history.with_left_edge(t("events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "event_id", SINCE)


@query(f"""
with s as (select *, lag(value >= 100) over (partition by user_id order by ts, event_id) was from events),
tr as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) r from s where value >= 100 and not was and ts >= timestamp '{SINCE}'),
latest as (select user_id as section, ts as transition_at from tr where r = 1),
watch as (select distinct user_id as section, event_type as watcher from events where event_type in ('view', 'click')),
sent as (select distinct user_id as section, 'click' as watcher from events where event_type = 'error')
select l.section, w.watcher, l.transition_at, count(*) over (partition by l.section) as watcher_count
from latest l join watch w on l.section = w.section
where not exists (select 1 from sent x where x.section = w.section and x.watcher = w.watcher)
""")
def t4_pending_alerts(spark, t):
    e = t("events")
    tr = history.open_transitions(e.drop("props"), "user_id", "ts", "event_id", F.col("value") >= 100, SINCE)
    latest = tr.groupBy(F.col("user_id").alias("section")).agg(F.max("ts").alias("transition_at"))
    watch = e.where(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("section"), F.col("event_type").alias("watcher")).distinct()
    sent = e.where("event_type = 'error'").select(F.col("user_id").alias("section"), F.lit("click").alias("watcher")).distinct()
    due = latest.join(watch, "section").join(sent, ["section", "watcher"], "left_anti")
    return due.withColumn("watcher_count", F.count("*").over(Window.partitionBy("section")))


@query("""
select user_id, event_id, ts, r as place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 20
""")
def t5_newest_points(spark, t):
    e = t("events").select("user_id", "event_id", "ts")
    return relational.cap_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20, "place").withColumn("place", F.col("place").cast("long"))


@query("""
with p as (select o_custkey, year(o_orderdate) as y, quarter(o_orderdate) as q, count(*) as n, sum(o_totalprice) as total from orders group by all),
r as (select *, row_number() over (partition by o_custkey order by (q = 3) desc, y desc, q desc) k from p where y < 2001)
select o_custkey, y::bigint as y, q::bigint as q, n, round(total, 2) as total from r where k = 1
""")
def t6_ghost_term(spark, t):
    p = t("orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return relational.latest_per_key(p.where("y < 2001"), ["o_custkey"], [F.desc(F.col("q") == 3), F.desc("y"), F.desc("q")])


@query("""
select user_id, hour, event_id, value from (select user_id, date_trunc('hour', ts) as hour, event_id, value, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts desc, event_id desc) r from events) where r = 1
""")
def t7_last_per_instant(spark, t):
    e = t("events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "event_id", "value")
    return relational.latest_per_key(e, ["user_id", "hour"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""
with f as (select event_type, min(ts) as anchor from events where value >= 50 group by 1), g as (select min(anchor) as live from f)
select e.event_id, e.event_type, epoch_us(e.ts) - epoch_us(f.anchor) + epoch_us(g.live) as aligned_us from events e join f using (event_type), g
""")
def t8_aligned_series(spark, t):
    e = t("events")
    f = e.where("value >= 50").groupBy("event_type").agg(F.min("ts").alias("anchor"))
    g = f.agg(F.min("anchor").alias("live"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.join(f, "event_type").join(F.broadcast(g)).select("event_id", "event_type", (us("ts") - us("anchor") + us("live")).alias("aligned_us"))


@query("""
with d as (select event_type, cast(ts as date) as day, round(max(value), 2) as v from events where value > 60 group by all),
g as (select a.event_type, b.day from (select distinct event_type from d) a, (select distinct day from d) b)
select g.event_type, g.day, last_value(d.v ignore nulls) over (partition by g.event_type order by g.day rows unbounded preceding) as v
from g left join d on d.event_type = g.event_type and d.day = g.day
""")
def w5_carry_forward(spark, t):
    d = t("events").where("value > 60").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.max("value"), 2).alias("v"))
    return relational.carry_forward(d, "event_type", "day", "v")


@query("""
select user_id, min_by(value, (ts, event_id)) as first_value, max_by(value, (ts, event_id)) as last_value,
       round(max_by(value, (ts, event_id)) - min_by(value, (ts, event_id)), 6) as delta, max(value) as top, count(*) as n
from events group by 1
""")
def t10_area_model(spark, t):
    at = F.struct("ts", "event_id")
    first, last = F.min_by("value", at), F.max_by("value", at)
    return t("events").groupBy("user_id").agg(first.alias("first_value"), last.alias("last_value"), F.round(last - first, 6).alias("delta"), F.max("value").alias("top"), F.count("*").alias("n"))


@query("""
select user_id, date_trunc('hour', ts) as w, count(*) as n, count(*) > 3 as limited from events group by all
""")
def t11_fixed_window(spark, t):
    n = F.count("*")
    return t("events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w")).agg(n.alias("n"), (n > 3).alias("limited"))


@query("""
with recursive e as (select distinct user_id, ts from events where user_id is not null and ts is not null), a as (select user_id, ts, ts + interval 12 hours as until from e),
n as materialized (select a.user_id, a.ts, (select min(e.ts) from e where e.user_id = a.user_id and e.ts >= a.until) as next from a),
s as (select user_id, min(ts) as ts from e group by 1 union all select s.user_id, n.next from s join n on n.user_id = s.user_id and n.ts = s.ts where n.next is not null),
h as (select event_id, v.user_id, v.ts, (select max(s.ts) from s where s.user_id = v.user_id and s.ts <= v.ts) as window_start from events v where v.user_id is not null and v.ts is not null)
select event_id, user_id, window_start, place, place <= 3 as allowed, greatest(0, 3 - place) as remaining,
 greatest(1, ceil((epoch_us(window_start) + 43200000000 - epoch_us(ts)) / 1000000.0))::bigint as retry_after_s
from (select *, row_number() over (partition by user_id, window_start order by ts, event_id) as place from h)
""")
def t11_first_hit_windows(spark, t):
    """At most three hits in the twelve hours from the first one."""
    return windows.first_hit_windows(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 12 * 3600, 3).drop("ts")


@query("""
select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as used from events
""")
def t12_sliding_budget(spark, t):
    e = t("events").select("event_id", "user_id", "ts")
    return history.used_in_range(e, "user_id", "ts", F.lit(1), 6 * 3600, "used").drop("ts")


@query("""
select event_id, user_id, round(sum(value) over (partition by user_id order by ts range between interval 1 hours preceding and current row), 4) as used from events
""")
def t13_hourly_quota(spark, t):
    e = t("events").select("event_id", "user_id", "ts", "value")
    return history.used_in_range(e, "user_id", "ts", F.col("value"), 3600, "used").select("event_id", "user_id", F.round("used", 4).alias("used"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then greatest(least(120 * power(2, least(o_orderkey % 15, 12)), 21600), base) else base end as seconds
from (select *, case substr(o_orderpriority, 1, 1) when '1' then 30.0 when '2' then 120.0 else 3600.0 end as base from orders)
""")
def t15_cadence(spark, t):
    rank = F.substring("o_orderpriority", 1, 1)
    base = F.when(rank == "1", 30.0).when(rank == "2", 120.0).otherwise(3600.0)
    backoff = F.least(F.pow(F.lit(2.0), F.least(F.col("o_orderkey") % 15, F.lit(12))) * 120, F.lit(21600.0))
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.greatest(backoff, base)).otherwise(base).alias("seconds"))


@query("""
with hot as (select distinct user_id from events where event_type = 'purchase' and value > 100), reg as (select distinct user_id from events where event_type = 'signup')
select c_custkey, case when h.user_id is not null and r.user_id is not null then 'registration' when h.user_id is not null then 'hot' else 'baseline' end as tier
from customer left join hot h on h.user_id = c_custkey left join reg r on r.user_id = c_custkey
""")
def t16_tier_assignment(spark, t):
    e = t("events")
    hot = e.where("event_type = 'purchase' and value > 100").select(F.col("user_id").alias("c_custkey"), F.lit(1).alias("hot")).distinct()
    reg = e.where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey"), F.lit(1).alias("reg")).distinct()
    c = t("customer").select("c_custkey").join(hot, "c_custkey", "left").join(reg, "c_custkey", "left")
    both = F.col("hot").isNotNull()
    return c.select("c_custkey", F.when(both & F.col("reg").isNotNull(), "registration").when(both, "hot").otherwise("baseline").alias("tier"))


@query("""
select user_id, event_id from events where ts <= timestamp '2024-01-15 00:00:00' and ts + interval 12 hours > timestamp '2024-01-15 00:00:00'
""")
def t17_active_windows(spark, t):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return t("events").where((F.col("ts") <= now) & (F.col("ts") + F.expr("interval 12 hours") > now)).select("user_id", "event_id")


@query("""
select o_orderkey, substr(o_orderpriority, 1, 1)::bigint as tier, 'worker-1' as leased_by from orders
where o_orderstatus = 'O' and o_orderdate <= timestamp '2000-01-01' and o_custkey % 7 <> 0 order by o_orderpriority, o_orderdate, o_orderkey limit 50
""")
def oq1_claim_jobs(spark, t):
    due = t("orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("o_custkey") % 7 != 0))
    return due.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("tier"), F.lit("worker-1").alias("leased_by"))


@query("""
with pairs as (select n.n_nationkey as subject, y as term from nation n, (select distinct year(o_orderdate)::bigint as y from orders) t),
offered as (select distinct c_nationkey as subject, year(o_orderdate)::bigint as term from orders join customer on c_custkey = o_custkey where o_totalprice > 499000)
select p.subject, p.term, (row_number() over (order by p.subject, p.term) - 1) * 30 as delay_s from pairs p where not exists (select 1 from offered o where o.subject = p.subject and o.term = p.term)
""")
def oq3_backfill_plan(spark, t):
    o = t("orders").withColumn("term", F.year("o_orderdate").cast("long"))
    pairs = t("nation").select(F.col("n_nationkey").alias("subject")).join(F.broadcast(o.select("term").distinct()))  # 25 nations by the years there are
    offered = o.where("o_totalprice > 499000").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("subject"), "term").distinct()
    place = F.row_number().over(Window.orderBy("subject", "term")) - 1
    return pairs.join(offered, ["subject", "term"], "left_anti").select("subject", "term", (place * 30).cast("long").alias("delay_s"))


@query("""
select distinct on (user_id, date_trunc('minute', ts)) user_id, date_trunc('minute', ts) as observed_at, event_id from events where value is not null order by user_id, date_trunc('minute', ts), event_id
""")
def k10_snapshot_capture(spark, t):
    e = t("events").where("value is not null").select("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("observed_at"), "event_id")
    return e.groupBy("user_id", "observed_at").agg(F.min("event_id").alias("event_id"))


@query("""
select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r <= 5
""")
def k15_row_caps(spark, t):
    return relational.cap_per_key(t("events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 5).drop("ts")


@query("""
select event_id, floor(w * 1000000 + 0.5) / 1000000 as weight from (
 select event_id, case when value is null then 0.25 when age <= 0 then 1 else greatest(0.05, floor(power(0.5, age / 30.0) * 1000000 + 0.5) / 1000000) end as w
 from (select event_id, value, 20.0 - day(ts) as age from events))
""")
def t_recency_weights(spark, t):
    age = F.when(F.col("value").isNotNull(), 20.0 - F.dayofmonth("ts"))
    return t("events").select("event_id", round_half_up(recency_weight(age, 30.0), 6).alias("weight"))


@query("""
select o_orderkey, floor(1e6 * (1 + (o_totalprice - lo) / (hi - lo)) + 0.5) / 1e6 as score from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
""")
def w7_rescaled_scores(spark, t):
    out = relational.rescale(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.0, 2.0, "score")
    return out.select("o_orderkey", round_half_up(F.col("score"), 6).alias("score"))


@query("""
select o_custkey, o_orderkey, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders
""")
def w2_previous_status(spark, t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.lag("o_orderstatus").over(w).alias("previous"))


@query("""
select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r = 1
""")
def w3_latest_per_key(spark, t):
    at = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
    return t("orders").groupBy("o_custkey").agg(at.alias("r")).select("o_custkey", "r.o_orderkey", "r.o_orderdate")


@query("""
select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_signup from events
""")
def w6_sticky_value(spark, t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))
