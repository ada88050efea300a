"""Streaming forms of the readings operators, drained over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.plans.registry import query
from lumenforge.streaming import readings


@query("""
with s as (select *, event_type = 'purchase' as o, lag(event_type = 'purchase') over (partition by user_id order by ts, event_id) as p from events)
select user_id, event_id, ts from s where o and not p
""")
def t1_opened_stream(spark, t):
    s = t.stream("events").select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("is_open"))
    # a late file can undo a transition, so histories are read once all files are in
    return readings.opened_in_order(readings.drain(s, "opened"), "user_id", "ts", "event_id", "is_open")


@query("select distinct user_id, date_trunc('minute', ts) as ts from events where value is not null")
def k10_captured_stream(spark, t):
    s = t.stream("events").withColumn("ts", F.date_trunc("minute", "ts"))
    return readings.drain(readings.captured(s, "user_id", "ts", "value", None).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")), "captured")


@query("""
with w as (select user_id from events group by 1 order by count(*) desc, user_id limit 60)
select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events semi join w using (user_id) group by 1
""")
def s24_watched_stream(spark, t):
    watched = t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(60)
    s = t.stream("events").select("user_id", "ts", "event_id", "event_type")
    return readings.drain(readings.watched_latest(s, watched, "user_id", "ts", "event_id"), "watched", "complete")
