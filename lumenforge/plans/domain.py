"""Graphs, audits and recommendations (G) on stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.operators import audits, graph, relational
from lumenforge.plans.registry import query

_ALL_EDGES = "(select distinct p_partkey as src, p_partkey + p_size as dst from part where p_size is not null)"


def _all_edges(t):
    return t("part").where("p_size is not null").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst")).distinct()


@query(f"""
with recursive r as (select p_partkey as root, p_partkey as node, 0 as distance from part where p_partkey % 50 = 0 union select root, dst, distance + 1 from r join {_ALL_EDGES} e on e.src = r.node where distance < 3)
select root, node, min(distance)::bigint as distance from r group by all
""")
def g7_neighbourhood_all(spark, t):
    roots = t("part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("root"))
    return graph.reach(_all_edges(t), roots, "src", "dst", 3)


_TREE_EDGES = "(select distinct p_partkey // 2 as src, p_partkey as dst from part where p_partkey > 1 union select p_partkey * 2 // 3, p_partkey from part where p_partkey > 1)"


def _tree_edges(t):
    """Every part asks for the parts at half and at two thirds of its number: paths are long, but no longer than the logarithm of the table."""
    p = t("part").where("p_partkey > 1")
    return p.select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst")).union(p.select(F.expr("p_partkey * 2 div 3"), "p_partkey")).distinct()


@query(f"""
with recursive e as (select * from {_TREE_EDGES}), r as (select n as node, 0 as depth from (select src as n from e union select dst from e) union select dst, depth + 1 from r join e on e.src = r.node)
select node, max(depth)::bigint as depth from r group by 1
""")
def g5_depths_all(spark, t):
    return graph.depths(_tree_edges(t), "src", "dst")


@query(f"""
with recursive e as (select * from {_TREE_EDGES}), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst),
d as (select src as node, count(*) as descendants from r group by 1), a as (select dst as node, count(*) as ancestors from r group by 1)
select node, coalesce(descendants, 0)::bigint as descendants, coalesce(ancestors, 0)::bigint as ancestors from d full join a using (node)
""")
def g6_reach_counts(spark, t):
    """How many parts each part leads to, and how many lead to it, over paths of any length."""
    return graph.reach_counts(_tree_edges(t), "src", "dst")


@query(f"with e as (select * from {_ALL_EDGES}) select src as node, count(*) as unlocks, ln(1 + count(*)) as gain from e group by 1")
def g4_unlock_counts_all(spark, t):
    return _all_edges(t).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("unlocks"), F.log1p(F.count("*")).alias("gain"))


@query("""
with g as (select * from (values (1, 'PROMO', 3), (2, 'SMALL', 2), (3, 'ECONOMY', 10)) v(gid, kind, need)),
have as (select o_custkey, p_type, count(distinct p_partkey) as n from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by all)
select h.o_custkey, g.gid::bigint as gid, case when h.n >= g.need then 'met' else 'partial' end as status, least(1.0, h.n / g.need::double) as fraction from have h join g on g.kind = h.p_type
""")
def g10_audit_n_of(spark, t):
    g = spark.createDataFrame([(1, "PROMO", 3), (2, "SMALL", 2), (3, "ECONOMY", 10)], "gid long, p_type string, need long")
    p = t("part").join(F.broadcast(g), "p_type").select("p_partkey", "gid", "need")
    l = t("lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    have = l.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "gid", "need").agg(F.count_distinct("p_partkey").alias("n"))
    return have.select("o_custkey", "gid", F.when(F.col("n") >= F.col("need"), "met").otherwise("partial").alias("status"), F.least(F.lit(1.0), F.col("n") / F.col("need")).alias("fraction"))


@query("""
with x as (select o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) over (partition by o_custkey order by (o_orderstatus = 'P'), o_orderkey rows between unbounded preceding and 1 preceding) as before from orders)
select o_custkey, count(*) as used, round(least(sum(o_totalprice), 500000), 2) as counted from x where coalesce(before, 0) < 500000 group by 1
""")
def g10_points_matching(spark, t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") == "P", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    x = t("orders").withColumn("before", F.coalesce(F.sum("o_totalprice").over(w), F.lit(0.0))).where("before < 500000")
    return x.groupBy("o_custkey").agg(F.count("*").alias("used"), F.round(F.least(F.sum("o_totalprice"), F.lit(500000.0)), 2).alias("counted"))


@query("""
with f as (select label, case when vec_id % 3 = 0 then 3.0 when vec_id % 3 = 1 then 1.0 else 0.25 end as w, unnest(embedding) as v, unnest(range(1, 65)) as i from embeddings)
select label, i::bigint as i, round(sum(w * v) / sum(w), 5) as taste from f group by all
""")
def g15_taste_vectors(spark, t):
    w = F.when(F.col("vec_id") % 3 == 0, 3.0).when(F.col("vec_id") % 3 == 1, 1.0).otherwise(0.25)
    f = t("embeddings").select("label", w.alias("w"), F.posexplode("embedding").alias("p", "v"))
    return f.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 5).alias("taste"))


@query("""
with f as (select o_custkey, o_orderkey, (8 * (o_orderstatus <> 'F')::bigint + 4 * coalesce((o_totalprice < 200000), true)::bigint + 2 * (o_orderpriority < '3')::bigint + (o_orderkey % 2 = 0)::bigint) as fit from orders)
select o_custkey, o_orderkey, round(fit / 15.0, 6) as fit from (select *, row_number() over (partition by o_custkey order by fit desc, o_orderkey) r from f) where r = 1
""")
def g17_section_choice(spark, t):
    i = lambda c: c.cast("long")
    fit = 8 * i(F.col("o_orderstatus") != "F") + 4 * i(F.col("o_totalprice") < 200000) + 2 * i(F.col("o_orderpriority") < "3") + i(F.col("o_orderkey") % 2 == 0)
    best = relational.latest_per_key(t("orders").select("o_custkey", "o_orderkey", fit.alias("fit")), ["o_custkey"], [F.desc("fit"), F.col("o_orderkey")])
    return best.withColumn("fit", F.round(F.col("fit") / 15.0, 6))


@query("""
with x as (select o_custkey, year(o_orderdate)::bigint as term, count(*) as n, round(sum(o_totalprice), 2) as points from orders group by all)
select o_custkey, term, case when n > 3 then 'overload' when n < 2 then 'underload' else 'ok' end as issue, round(sum(points) over (partition by o_custkey order by term rows unbounded preceding), 2) as completed from x
""")
def g22_plan_check(spark, t):
    x = t("orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("term")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("points"))
    w = Window.partitionBy("o_custkey").orderBy("term").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("o_custkey", "term", F.when(F.col("n") > 3, "overload").when(F.col("n") < 2, "underload").otherwise("ok").alias("issue"), F.round(F.sum("points").over(w), 2).alias("completed"))


@query("""
select doc_id, p::bigint as positive, n::bigint as negative, case when p + n = 0 then 0.0 else round((p - n) / (p + n)::double * (p + n) / (p + n + 1), 6) end as sentiment
from (select doc_id, regexp_matches(text, '(?i)(^|\\s)(the|der|le|el)(\\s|$)')::bigint + regexp_matches(text, '(?i)(^|\\s)(and|und|et|y)(\\s|$)')::bigint as p, regexp_matches(text, '!!')::bigint + regexp_matches(text, '\\*\\*\\*')::bigint as n from documents)
""")
def g27_review_cues(spark, t):
    hit = lambda p: F.col("text").rlike(p).cast("long")
    d = t("documents").select("doc_id", (hit("(?i)(^|\\s)(the|der|le|el)(\\s|$)") + hit("(?i)(^|\\s)(and|und|et|y)(\\s|$)")).alias("positive"), (hit("!!") + hit("\\*\\*\\*")).alias("negative"))
    e = F.col("positive") + F.col("negative")
    return d.withColumn("sentiment", F.when(e == 0, 0.0).otherwise(F.round((F.col("positive") - F.col("negative")) / e * e / (e + 1), 6)))


_GROUPS = "(values (1, 1, 3, 0), (1, 2, 2, 1), (1, 3, 1, 2), (1, 4, 1, 9)) g(program, grp, need, other)"
_MEMBERS = "(select distinct 1 as program, 1 as grp, p_partkey as course from part where p_type = 'PROMO' union select 1, 2, p_partkey from part where p_size <= 20 union select 1, 3, p_partkey from part where p_retailprice > 1000 union select 1, 4, p_partkey from part where p_brand like '%2')"


@query(f"""
with g as (select * from {_GROUPS}), m as {_MEMBERS}, t as (select distinct o_custkey, l_partkey as course from orders join lineitem on l_orderkey = o_orderkey),
f as (select o_custkey, program, grp, course from t join m using (course)), s as (select distinct f.o_custkey, g.program, g.grp, f.course from f join g on g.program = f.program and g.other = f.grp),
x as (select f.o_custkey, f.program, f.grp, count(*) - count(s.course) as matched, count(s.course) as spent from f left join s on s.o_custkey = f.o_custkey and s.program = f.program and s.grp = f.grp and s.course = f.course group by all)
select o_custkey, program::bigint as program, grp::bigint as grp, matched, spent, case when matched >= need then 'met' when matched > 0 then 'partial' else 'unmet' end as status from x join g using (program, grp)
""")
def g11_exclusion_audit(spark, t):
    g = spark.createDataFrame([(1, 1, 3, 0), (1, 2, 2, 1), (1, 3, 1, 2), (1, 4, 1, 9)], "program long, grp long, need long, other long")
    tests = {1: F.col("p_type") == "PROMO", 2: F.col("p_size") <= 20, 3: F.col("p_retailprice") > 1000, 4: F.col("p_brand").endswith("2")}
    fits = F.array_compact(F.array(*[F.when(test, F.lit(k).cast("long")) for k, test in tests.items()]))
    members = t("part").select(F.lit(1).cast("long").alias("program"), F.explode(fits).alias("grp"), F.col("p_partkey").alias("course"))
    taken = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("l_partkey").alias("course"))
    return audits.audit(taken, members, g.select("program", "grp", "need"), g.select("program", "grp", "other"), "o_custkey")
