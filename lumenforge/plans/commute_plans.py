"""Commutes (G21) on stand-in tables: an order's lines as a day's items, nations as places and regions as zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.operators import commute
from lumenforge.plans.registry import query

_LEGS = r"""
places as (select n_name as place, case when n_nationkey % 7 <> 6 then 'R' || n_regionkey end as zone, n_regionkey as r, case when n_nationkey % 5 <> 4 then 40.8 + n_nationkey * 0.0007 end as lat, -73.96 + n_regionkey * 0.001 as lng from nation),
zones as (select distinct 'R' || n_regionkey as z, n_regionkey as r from nation union all select 'unknown', null),
walks as (select a.z as from_zone, b.z as to_zone, case when a.r is null or b.r is null then 15 else 8 + 9 * abs(a.r - b.r) end as minutes, coalesce(abs(a.r - b.r) >= 2, false) as crosses from zones a, zones b),
items as (select o_custkey as person, o_orderdate as day, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey as item, 480 + l_partkey * 37 % 720 as s, 480 + l_partkey * 37 % 720 + 20 + l_quantity::bigint as e, n_name as place, l_partkey
 from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
pairs as (select *, lead(item) over w as next_item, lead(s) over w - e as gap, lead(place) over w as next_place from items window w as (partition by person, day order by s, e, item, l_partkey)),
ends as (select p.*, coalesce(f.zone, 'unknown') as from_zone, coalesce(g.zone, 'unknown') as to_zone, f.lat as a, f.lng as b, g.lat as c, g.lng as d from pairs p left join places f on f.place = p.place left join places g on g.place = p.next_place
 where gap >= 0 and p.place <> next_place and not p.place like '%\_3' escape '\' and not next_place like '%\_3' escape '\'),
metres as (select *, 2 * 6371000 * asin(least(1.0, sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2))) as m from ends),
legs as (select person, day, item, next_item, from_zone, to_zone, gap, coalesce(case when from_zone = to_zone and from_zone <> 'unknown' then greatest(1.0, round(m * 1.3 / 78)) end, minutes)::bigint as walk, crosses from metres join walks using (from_zone, to_zone))
"""


def _legs(t):
    nation = t("nation")
    near = F.when(F.col("n_nationkey") % 5 != 4, 40.8 + F.col("n_nationkey") * 0.0007)
    zone = F.when(F.col("n_nationkey") % 7 != 6, F.concat(F.lit("R"), "n_regionkey"))
    places = nation.select(F.col("n_name").alias("place"), zone.alias("zone"), near.alias("lat"), (-73.96 + F.col("n_regionkey") * 0.001).alias("lng"))
    zones = nation.select(F.concat(F.lit("R"), "n_regionkey").alias("z"), F.col("n_regionkey").alias("r")).distinct().union(nation.sparkSession.createDataFrame([("unknown", None)], "z string, r long"))
    apart = F.abs(F.col("a.r") - F.col("b.r"))
    walks = zones.alias("a").join(F.broadcast(zones.alias("b"))).select(F.col("a.z").alias("from_zone"), F.col("b.z").alias("to_zone"), F.coalesce(8 + 9 * apart, F.lit(15)).alias("minutes"), F.coalesce(apart >= 2, F.lit(False)).alias("cross"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    start = 480 + F.col("l_partkey") * 37 % 720
    items = lines.select(F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("day"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("item"), start.alias("start"), (start + 20 + F.col("l_quantity").cast("long")).alias("end"), F.col("n_name").alias("place"))
    return commute.legs(items, places, walks, "person", "day", F.col("place").endswith("_3"))


@query(f"with {_LEGS} select person, day, item, next_item, from_zone, to_zone, gap, walk, gap >= walk as feasible, crosses as \"cross\" from legs")
def g21_commute_legs(spark, t):
    return _legs(t)


@query(f"""
with {_LEGS}, s as (select *, gap - walk as slack, from_zone <> 'unknown' and to_zone <> 'unknown' as known from legs)
select person, day, item, next_item, case when slack < 0 then case when known then 'hard' else 'soft' end when known and crosses then case when slack < 5 then 'hard' else 'soft' end else 'soft' end as severity
from s where slack < 5 or known and crosses
""")
def g21_commute_conflicts(spark, t):
    """Legs that do not fit, that cross campuses, or that are tight."""
    return commute.with_severity(_legs(t)).select("person", "day", "item", "next_item", "severity")


@query(f"with {_LEGS} select person, day, sum(walk)::bigint as walk, count(*) as legs from legs group by all")
def g21_walk_by_day(spark, t):
    return commute.minutes_by_day(_legs(t), "person", "day")
