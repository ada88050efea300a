"""Batches of a job queue (O-Q2) on orders as jobs and lines as reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.operators import queue
from lumenforge.plans.registry import query

_TIER = "case {} when 0 then 'registration' when 1 then 'hot' else 'baseline' end"
_WAIT = "to_seconds(least(greatest(floor(case {t} when 'registration' then 30 when 'hot' then 120 else 3600 end * power(2, {d}) * (0.75 + 0.5 * (o_orderkey % 1000) / 1000)), 5), 86400)::bigint)"


def _at(days: str):
    return F.expr(f"o_orderdate + make_dt_interval(cast({days} as int), 0, 0, 0)")


@query(f"""
with j as (select o_orderkey, o_orderdate + interval 1 day * (o_custkey % 9) as nf, {_TIER.format('o_custkey % 4')} as tier, o_custkey, o_orderdate as d from orders),
s as (select o_orderkey, case when o_orderkey % 4 <> 3 then 1 end as has_job, case when o_custkey % 5 > 0 then 1 end as has_spec, tier, {_TIER.format('o_custkey % 3')} as t2, o_custkey % 7 = 0 as due, case when o_custkey % 2 = 0 then timestamp '1999-01-01' end as given, nf from j),
n as (select *, timestamp '1997-01-01' + {_WAIT.format(t='t2', d='0')} as waits from s)
select o_orderkey, case when has_spec = 1 then 'spec' else 'job' end as url, case when has_spec = 1 then t2 else tier end as tier,
case when has_spec is null then nf when due then coalesce(given, timestamp '1997-01-01') when has_job is null then coalesce(given, waits)
 when (t2 = 'registration' and tier <> 'registration') or (t2 = 'hot' and tier = 'baseline') then least(nf, waits) else nf end as next_fetch_at,
case when has_spec = 1 then has_job is null end as inserted from n where has_job = 1 or has_spec = 1
""")
def oq2_enqueued(spark, t):
    o = t("orders").repartition(t.parts("orders"), "o_orderkey")
    jobs = o.where("o_orderkey % 4 <> 3").select("o_orderkey", F.lit("job").alias("url"), F.expr(_TIER.format("o_custkey % 4")).alias("tier"), _at("o_custkey % 9").alias("next_fetch_at"))
    specs = o.where("o_custkey % 5 > 0").select("o_orderkey", F.lit("spec").alias("url"), F.expr(_TIER.format("o_custkey % 3")).alias("tier"), (F.col("o_custkey") % 7 == 0).alias("due_now"), F.expr("case when o_custkey % 2 = 0 then timestamp_ntz '1999-01-01' end").alias("next_at"))
    return queue.enqueued(jobs, specs, "o_orderkey", F.expr("timestamp_ntz '1997-01-01'"), (F.col("o_orderkey") % 1000) / 1000)


@query(f"""
with j as (select o_orderkey, {_TIER.format('o_custkey % 4')} as tier, o_orderdate as nf, o_custkey % 9 as failures, o_custkey % 5 as token from orders),
r as (select o_orderkey, l_linenumber % 3 = 0 as ok, l_linenumber % 5 as token, 'line ' || l_linenumber as error from lineitem join orders on o_orderkey = l_orderkey),
b as (select o_orderkey, true as has, coalesce(bool_or(r.token = j.token), false) as acc, (array_agg((r.ok, r.error) order by r.ok, r.error) filter (r.token = j.token))[1] as o from r join j using (o_orderkey) group by 1)
select o_orderkey, tier, case when acc then timestamp '1997-01-01' + {_WAIT.format(t='tier', d='case when o[1] then 0 else least(failures, 6) end')} else nf end as next_fetch_at,
case when acc and o[1] then timestamp '1997-01-01' end as last_ok_at, case when not coalesce(acc, false) then failures when o[1] then 0 else failures + 1 end::bigint as failures,
case when acc and not o[1] then o[2] end as last_error, case when coalesce(acc, false) then null else token end::bigint as lease_token, acc as accepted from j left join b using (o_orderkey)
""")
def oq2_completed(spark, t):
    n = t.parts("lineitem")
    o = t("orders").repartition(n, "o_orderkey")
    jobs = o.select("o_orderkey", F.expr(_TIER.format("o_custkey % 4")).alias("tier"), F.col("o_orderdate").alias("next_fetch_at"), F.expr("cast(null as timestamp_ntz)").alias("last_ok_at"), (F.col("o_custkey") % 9).alias("failures"), F.lit(None).cast("string").alias("last_error"), (F.col("o_custkey") % 5).alias("lease_token"))
    line = F.col("l_linenumber")
    outcomes = t("lineitem").repartition(n, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), (line % 3 == 0).alias("ok"), (line % 5).alias("lease_token"), F.concat(F.lit("line "), line).alias("error"), F.expr("cast(null as timestamp_ntz)").alias("next_at"))
    return queue.completed(jobs, outcomes, "o_orderkey", F.expr("timestamp_ntz '1997-01-01'"), (F.col("o_orderkey") % 1000) / 1000)
