"""Queries of requirement rules, roll-ups and selectors (G10, G12, A20, F18, F19, O11) on stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.operators import rules
from lumenforge.plans.registry import query

_KINDS = [(1, 1, "all_of", 0.0), (1, 2, "n_of", 2.0), (1, 3, "sequence_choice", 0.0), (1, 4, "n_matching", 3.0), (1, 5, "points_matching", 12.0), (2, 1, "attested", 0.0), (2, 2, "n_of", 1.0), (2, 3, "points_matching", 4.0)]
_GROUPS = "(values " + ", ".join(f"({p}, {g}, '{k}', {n}::double)" for p, g, k, n in _KINDS) + ") g(program, grp, kind, need)"

_BASE = f"""
people as (select c_custkey, 1 as program from customer union all select c_custkey, 2 from customer where c_custkey % 3 = 0),
taken as (select o_custkey as c_custkey, l_partkey as course, bool_and(o_orderstatus = 'P') as planned, (1 + max(l_linenumber) % 4)::double as points from orders join lineitem on l_orderkey = o_orderkey group by all),
g as (select * from {_GROUPS}),
wanted as (select 1 as program, 1 as grp, 0 as seq, p_partkey as course from part where p_partkey between 1 and 2 union all select 1, 2, 0, p_partkey from part where p_partkey between 10 and 60
 union all select 1, 3, p_partkey % 5, p_partkey from part where p_partkey between 100 and 130 and p_partkey % 5 > 0 union all select 2, 2, 0, p_partkey from part where p_partkey between 60 and 75),
members as (select 1 as program, 4 as grp, p_partkey as course from part where p_partkey <> 5 and (p_partkey = 7 or p_type = 'PROMO' and p_size between 10 and 40) union all select 1, 5, p_partkey from part where p_size <= 20 union all select 2, 3, p_partkey from part where p_type = 'SMALL'),
attested as (select c_custkey, 2 as program, 1 as grp from customer where c_custkey % 6 = 0),
sizes as (select program, grp, seq, count(*)::double as size from wanted group by all),
pool as (select program, grp, kind, 0 as seq, need as required, course from members join g using (program, grp)
 union all select program, grp, kind, seq, case when kind = 'n_of' then need else size end, course from wanted join sizes using (program, grp, seq) join g using (program, grp)),
hits as (select c_custkey, program, grp, kind, seq, required, course, points, planned, row_number() over w as place, coalesce(sum(points) over (w rows between unbounded preceding and 1 preceding), 0) as before,
 count(*) over (partition by c_custkey, program, grp, seq) / required as share from taken join people using (c_custkey) join pool using (program, course) window w as (partition by c_custkey, program, grp, seq order by planned, course)),
best as (select *, first_value(seq) over (partition by c_custkey, program, grp order by share desc, seq) as chosen from hits),
matched as (select * from best where (kind <> 'sequence_choice' or seq = chosen) and case when kind = 'points_matching' then before < required else place <= required end),
results as (select p.c_custkey, p.program, g.grp, g.kind, least(coalesce(d.required, a.asked), coalesce(case when g.kind = 'attested' then t.said end, d.amount, 0))::double as completed, coalesce(d.required, a.asked)::double as required
 from people p join g using (program)
 join (select program, grp, case when kind = 'attested' then 1 when kind in ('all_of', 'sequence_choice') then (select arg_min(size, seq) from sizes s where s.program = g.program and s.grp = g.grp) else need end as asked from g) a using (program, grp)
 left join (select c_custkey, program, grp, case when any_value(kind) = 'points_matching' then sum(points) else count(*) end as amount, any_value(required) as required from matched group by all) d on d.c_custkey = p.c_custkey and d.program = p.program and d.grp = g.grp
 left join (select *, 1 as said from attested) t on t.c_custkey = p.c_custkey and t.program = p.program and t.grp = g.grp),
audit as (select *, case when required <= 0 or completed >= required then 'satisfied' when completed > 0 then 'in_progress' else 'unmet' end as status from results)
"""


def _catalog(t):
    """The stand-in rules: people, what they took, groups, named courses, members by selectors, statements."""
    long = lambda x: F.lit(x).cast("long")
    p, c = t("part"), t("customer").select("c_custkey")
    people = c.withColumn("program", long(1)).unionByName(c.where("c_custkey % 3 = 0").withColumn("program", long(2)))
    n = t.parts("lineitem")
    lines = t("lineitem").repartition(n, "l_orderkey").join(t("orders").repartition(n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    taken = lines.repartition(n, "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("course")).agg(F.min(F.col("o_orderstatus") == "P").alias("planned"), (1 + F.max("l_linenumber") % 4).cast("double").alias("points"))
    groups = p.sparkSession.createDataFrame(_KINDS, "program long, grp long, kind string, need double")

    def rows(where: str, program: int, grp: int, seq="0"):
        return p.where(where).select(long(program).alias("program"), long(grp).alias("grp"), F.expr(seq).cast("long").alias("seq"), F.col("p_partkey").alias("course"))

    wanted = rows("p_partkey between 1 and 2", 1, 1).unionByName(rows("p_partkey between 10 and 60", 1, 2))
    wanted = wanted.unionByName(rows("p_partkey between 100 and 130 and p_partkey % 5 > 0", 1, 3, "p_partkey % 5")).unionByName(rows("p_partkey between 60 and 75", 2, 2))

    def selected(s: rules.Selector, program: int, grp: int):
        return p.where(_selected(s)).select(long(program).alias("program"), long(grp).alias("grp"), F.col("p_partkey").alias("course"))

    members = selected(_SELECTOR, 1, 4).unionByName(selected(rules.Selector(numbers=(0, 20)), 1, 5)).unionByName(selected(rules.Selector(subjects=["SMALL"]), 2, 3))
    attested = c.where("c_custkey % 6 = 0").select("c_custkey", long(2).alias("program"), long(1).alias("grp"))
    return people, taken, groups, wanted, members, attested


_SELECTOR = rules.Selector(include=[7], exclude=[5], subjects=["PROMO"], numbers=(10, 40))


def _selected(s: rules.Selector):
    return rules.selects(s, F.col("p_partkey"), F.col("p_type"), F.col("p_size"), F.array("p_brand"))


@query(f"with {_BASE} select c_custkey, program::bigint as program, grp::bigint as grp, kind, completed, required, status from audit")
def g10_audit_rules(spark, t):
    """All six kinds of rules, every group of everyone's programs."""
    return rules.evaluate(*_catalog(t), "c_custkey", t.parts("lineitem"))


@query(f"with {_BASE} select c_custkey, program::bigint as program, grp::bigint as grp, course, points, planned from matched")
def g10_counted_courses(spark, t):
    return rules.matched(*_catalog(t)[:5], "c_custkey", t.parts("lineitem")).select("c_custkey", "program", "grp", "course", "points", "planned")


@query(f"""
with {_BASE} select c_custkey, program::bigint as program, count(*) as n_groups, count_if(status = 'satisfied')::bigint as satisfied, round(avg(case when required > 0 then least(1.0, completed / required) else 1.0 end), 9) as progress from audit group by all
""")
def g12_program_progress(spark, t):
    return rules.roll_up(rules.evaluate(*_catalog(t), "c_custkey", t.parts("lineitem")), "c_custkey").withColumn("progress", F.round("progress", 9))


@query(f"with {_BASE} select c_custkey, program::bigint as program, course, count(distinct grp) as n_groups from matched group by all having count(distinct grp) > 1")
def a20_cross_counted(spark, t):
    return rules.cross_counted(rules.matched(*_catalog(t)[:5], "c_custkey", t.parts("lineitem")), "c_custkey")


@query(f"""
with {_BASE}, r as (select *, case when kind = 'attested' then 2 when kind in ('n_matching', 'points_matching') then 1 else 0 end as rank, required - completed as outstanding from audit where status <> 'satisfied')
select c_custkey, program::bigint as program, grp::bigint as grp, row_number() over (partition by c_custkey order by rank, outstanding, program, grp) as place from r
""")
def o11_remaining_requirements(spark, t):
    """What is left, by how surely it can be checked, then by how much is outstanding, then by label."""
    left = rules.evaluate(*_catalog(t), "c_custkey", t.parts("lineitem")).where("status <> 'satisfied'")
    rank = F.when(F.col("kind") == "attested", 2).when(F.col("kind").isin("n_matching", "points_matching"), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(rank, F.col("required") - F.col("completed"), "program", "grp"))
    return left.select("c_custkey", "program", "grp", place.cast("long").alias("place"))


@query("select p_partkey from part where p_partkey <> 5 and (p_partkey = 7 or p_type = 'PROMO' and p_size between 10 and 40)")
def f19_selector_scan(spark, t):
    """A selector as a predicate of the scan."""
    return t("part").where(_selected(_SELECTOR)).select("p_partkey")
