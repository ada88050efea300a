"""Recommendations (G13, G14, G16) and plan checks (G22) on stand-in tables: 2,000 courses numbered by parts, customers' orders as records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.operators import plan_check, recommend
from lumenforge.operators import prerequisites as pre
from lumenforge.plans.registry import query

_SQL = """
cat as (select distinct p_partkey % 2000 as c from part), k as (select c, c % 4 as k, c // 2 as a, c * 2 // 3 as b from cat),
lines as (select o_custkey as cust, l_partkey % 2000 as c, o_orderstatus as s, l_returnflag as f, l_linenumber as n from orders join lineitem on l_orderkey = o_orderkey),
taken as (select cust, c, case when bool_or(f = 'A') then true when bool_or(f = 'R') then false end as liked from lines where s = 'F' group by all),
done as (select cust, c from taken union select cust, c from lines where s = 'P'), refused as (select distinct cust, c from lines where s = 'O' and n = 5),
groups as (select c_custkey as cust, c, 1 as grp, 'x' as cluster from customer join cat on c % 400 = c_custkey % 400 union all select c_custkey, c, 2, 'x' from customer join cat on c % 320 = c_custkey % 320
 union all select c_custkey, c, 3, null from customer join cat on c % 200 = c_custkey % 200),
credited as (select cust, c, grp from groups g where cluster is null or not exists (from groups o where o.cust = g.cust and o.c = g.c and o.cluster = g.cluster and o.grp < g.grp)),
asked as (select cust, c from groups union select cust, k.c from taken t join k on k.c // 2 = t.c),
ask as (select cust, c from asked anti join done using (cust, c) anti join refused using (cust, c)),
state as (select ask.cust, k.c, k, a, b, x.c is not null as ha, y.c is not null as hb, case k when 0 then false when 1 then x.c is null and y.c is null when 2 then x.c is null or y.c is null else x.c is null end as held
 from ask join k using (c) left join done x on x.cust = ask.cust and x.c = a left join done y on y.cust = ask.cust and y.c = b),
vecs as (select vec_id as c, embedding::double[] as v from embeddings where vec_id < 2000),
mean as (select cust, i, sum(w * x) / sum(w) as m from (select cust, case when liked then 3.0 when not liked then 0.25 else 1.0 end as w, unnest(v) as x, unnest(range(64)) as i from taken join vecs using (c)) group by all),
taste as (select cust, list(m order by i) as t from mean group by 1),
seen as (select state.cust, state.c, k, v, coalesce(case when v is not null and t is not null then list_cosine_similarity(v, t) end, 0.0) as near from state left join vecs using (c) left join taste using (cust) where not held),
away as (select s.cust, s.c, greatest(0.0, max(list_cosine_similarity(s.v, r.v))) as away from seen s join (select cust, v from refused join vecs using (c)) r on r.cust = s.cust where s.v is not null group by all),
opens as (select s.cust, s.c, count(*) as n from seen s join k i on (i.a = s.c or i.k <> 3 and i.b = s.c) and i.k <> 0 anti join done d on d.cust = s.cust and d.c = i.c
 left join done x on x.cust = s.cust and x.c = i.a left join done y on y.cust = s.cust and y.c = i.b where case i.k when 1 then x.c is null and y.c is null when 2 then x.c is null or y.c is null else true end group by all),
near as (select cust, c, list(o order by p) as alike from (select s.cust, s.c, t.c as o, row_number() over (partition by s.cust, s.c order by list_cosine_similarity(s.v, w.v) desc, t.c) as p
 from seen s join taken t on t.cust = s.cust join vecs w on w.c = t.c where s.v is not null and s.near >= 0.15 and list_cosine_similarity(s.v, w.v) > 0) where p <= 3 group by all),
counts as (select cust, c, count(*) as n, list(grp order by grp) as l from credited group by all),
scored as (select seen.*, coalesce(g.n, 0) as groups, coalesce(g.l, []) as l, coalesce(u.n, 0) as unlocked, coalesce(e.away, 0.0) as away, coalesce(m.alike, []) as alike, seen.cust in (select cust from taken) as recorded,
 1.0 * coalesce(g.n, 0) + 0.5 * near + 0.3 * ln(1 + coalesce(u.n, 0)) - 0.6 * coalesce(e.away, 0.0) as score
 from seen left join counts g using (cust, c) left join opens u on u.cust = seen.cust and u.c = seen.c left join away e on e.cust = seen.cust and e.c = seen.c left join near m on m.cust = seen.cust and m.c = seen.c),
best as (select * from (select *, row_number() over (partition by cust order by score desc, c) as place from scored) where place <= 10)
"""


def _code(c):
    return F.concat(F.lit("PART"), 1000 + c, F.lit("W"))


def _parsed(t):
    c = F.col("c")
    a, b = (F.format_string("W%d", 1000 + F.expr(x)) for x in ("c div 2", "c * 2 div 3"))
    kind = c % 4
    text = F.when(kind == 1, F.concat(a, F.lit(" or "), b, F.lit("."))).when(kind == 2, F.concat(a, F.lit(" and "), b, F.lit(", or permission of the instructor."))).when(kind == 3, F.concat(a, F.lit(" and knowledge of Java")))
    return pre.parse(t("part").select((F.col("p_partkey") % 2000).alias("c")).distinct().select(_code(c).alias("course"), text.alias("text")), "text", F.lit("PART"))


def _records(t):
    """What customers took, planned and turned down; the groups that they have open, and the courses to choose from."""
    lines = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("cust"), (F.col("l_partkey") % 2000).alias("c"), "o_orderstatus", "l_returnflag", "l_linenumber")
    flag = F.col("l_returnflag")
    taken = lines.where("o_orderstatus = 'F'").groupBy("cust", "c").agg(F.when(F.bool_or(flag == "A"), True).when(F.bool_or(flag == "R"), False).alias("liked"))
    planned = lines.where("o_orderstatus = 'P'").select("cust", "c").distinct()
    refused = lines.where("o_orderstatus = 'O' and l_linenumber = 5").select("cust", "c").distinct()
    courses = t("part").select((F.col("p_partkey") % 2000).alias("c")).distinct()
    people = t.dealt("customer").select(F.col("c_custkey").alias("cust"))  # a customer becomes some twenty rows

    def group(n: int, every: int, cluster):
        own = people.withColumn("_m", F.col("cust") % every).join(courses.withColumn("_m", F.col("c") % every), "_m")
        return own.select("cust", "c", F.lit(n).cast("long").alias("grp"), F.lit(n).alias("place"), F.lit(cluster).cast("string").alias("cluster"))

    outstanding = group(1, 400, "x").unionByName(group(2, 320, "x")).unionByName(group(3, 200, None))
    following = taken.select("cust", F.explode(F.array(F.col("c") * 2, F.col("c") * 2 + 1)).alias("c")).join(courses, "c")
    coded = lambda df: df.withColumn("course", _code(F.col("c"))).drop("c")
    return coded(taken), coded(planned), coded(refused), coded(outstanding), coded(outstanding.select("cust", "c").union(following.select("cust", "c")))


def _recommended(t):
    taken, planned, refused, outstanding, candidates = _records(t)
    vectors = t("embeddings").where("vec_id < 2000").select(_code(F.col("vec_id")).alias("course"), F.col("embedding").alias("vec"))
    return recommend.recommend(candidates, taken, planned, refused, vectors, outstanding, _parsed(t), "cust", "course", 10, 20, max_depth=2)


@query(f"""
with {_SQL} select cust, 'PART' || (1000 + c) || 'W' as course, place, round(score, 6) as score, groups::bigint as groups, unlocked::bigint as unlocked, round(near * 0.5, 6) as taste_fit, round(away, 6) as rejection from best
""")
def g13_recommendations(spark, t):
    """The ten best courses for everyone, behind the gate of prerequisites."""
    got, _ = _recommended(t)
    r = lambda c: F.round(c, 6).alias(c)
    return got.select("cust", "course", "place", r("score"), F.size("groups").cast("long").alias("groups"), F.size("unlocked").cast("long").alias("unlocked"), r("taste_fit"), r("rejection"))


@query(f"""
with {_SQL} select * from (select cust, 'PART' || (1000 + c) || 'W' as course, case when k = 2 then 'prereq_unmet_but_permission' else 'prereq_unmet' end as reason,
 (case when k = 2 then (not ha)::int + (not hb and a <> b)::int else 1 end)::bigint as open_choices, row_number() over (partition by cust order by k <> 2, c) as place from state where held) where place <= 20
""")
def g13_withheld(spark, t):
    """Candidates that the gate holds back, with why and how many choices are open, those that a permission could open first."""
    taken, planned, refused, _, candidates = _records(t)
    held = recommend.held_back(candidates, taken, planned, refused, _parsed(t), "cust", "course", 20, max_depth=2)
    return held.select("cust", "course", "place", "reason", F.size("missing").cast("long").alias("open_choices"))


@query(f"""
with {_SQL} select cust, 'PART' || (1000 + c) || 'W' as course, array_to_string(list_concat(list_concat([(case when len(alike) > 0 then 'interesting_and_counts:' else 'required:' end) || g for g in l],
 case when len(alike) > 0 and groups = 0 then ['because_you_took'] else [] end), case when recorded and unlocked >= 2 then ['unlocks:' || unlocked] else [] end), ' ') as reasons,
 array_to_string(['PART' || (1000 + o) || 'W' for o in alike], ' ') as "similar", concat_ws(' ', case when k = 3 then 'prereq_unknown' end, case when v is null then 'no_vector' end) as caveats from best
""")
def g14_reasons(spark, t):
    got, _ = _recommended(t)
    return got.select("cust", "course", *(F.array_join(c, " ").alias(c) for c in ("reasons", "similar", "caveats")))


@query(f"with {_SQL} select cust, 'PART' || (1000 + c) || 'W' as course, grp::bigint as grp from credited")
def g16_credited_groups(spark, t):
    """The groups that a course counts for: one of each exclusion cluster."""
    return recommend.credited_groups(_records(t)[3], "cust", "course").select("cust", "course", "grp")


_PLAN = """
lines as (select o_custkey as cust, year(o_orderdate) * 2 + (month(o_orderdate) > 6)::int as term, l_partkey % 50 as c, l_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey),
plan as (select cust, term, c, row_number() over (partition by cust, term order by l_orderkey, l_linenumber, c) as place from lines),
cat as (select distinct p_size % 50 as c, case when p_size % 50 % 11 <> 5 then 2 + p_size % 50 % 5 end as points from part where p_size % 10 <> 9),
first as (select cust, c, min(term) as t from plan group by all), x as (select plan.*, points, cat.c is not null as known, lag(term) over (partition by cust, plan.c order by term, place) as before from plan left join cat using (c)),
k as (select c, c % 4 as k, c // 2 as a, c * 2 // 3 as b from cat), eq as (select c, case when c % 7 = 0 then c + 1 else c - 1 end as o from cat where c % 7 < 2),
h as (select x.cust, x.term, x.place, x.c, k, a, b, coalesce(fa.t < x.term, false) as ha, coalesce(fb.t < x.term, false) as hb, coalesce(fb.t <= x.term, false) as wb, a in (select c from cat) as ia, b in (select c from cat) as ib
 from x join k using (c) left join first fa on fa.cust = x.cust and fa.c = a left join first fb on fb.cust = x.cust and fb.c = b where known),
choice as (select cust, term, place, c, k, case when a = b then [a] else [least(a, b), greatest(a, b)] end as o, ia or ib as inside from h where k = 1 and not ha and not hb
 union all select cust, term, place, c, k, [a], ia from h where k in (2, 3) and not ha union all select cust, term, place, c, k, [b], ib from h where k = 2 and not hb and a <> b),
loads as (select cust, term, coalesce(sum(points), 0) as points, count_if(known and points is null) as open from x group by all),
issues as (select cust, term, place, c, 'duplicate_course' as kind, 'error' as severity, []::bigint[] as o, null::bigint as other from x where before is not null
 union all select cust, term, place, c, 'unknown_course', 'warning', [], null from x where not known
 union all select distinct x.cust, x.term, x.place, x.c, 'equivalent_conflict', 'warning', []::bigint[], eq.o from x join eq on eq.c = x.c join plan p on p.cust = x.cust and p.c = eq.o and (p.term < x.term or p.term = x.term and p.place < x.place) where known
 union all select cust, term, place, c, case when inside then 'prereq_unmet' else 'prereq_external' end, case when inside and k <> 2 then 'error' else 'warning' end, o, null from choice
 union all select cust, term, place, c, 'corequisite_unmet', 'error', [b], null from h where k = 3 and not wb
 union all select cust, term, null, null, case when points > 18 then 'over_load' else 'under_load' end, 'warning', [], null from loads where points > 18 or points < 12 and open = 0)
"""


def _plans(t):
    """Customers' lines as courses of half years, and the 50 courses with points, prerequisites and equivalents."""
    lines = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    term = F.year("o_orderdate") * 2 + (F.month("o_orderdate") > 6).cast("int")
    own = lines.select(F.col("o_custkey").alias("cust"), term.alias("term"), _code(F.col("l_partkey") % 50).alias("course"), "l_orderkey", "l_linenumber")
    plan = own.withColumn("place", F.row_number().over(Window.partitionBy("cust", "term").orderBy("l_orderkey", "l_linenumber", "course"))).drop("l_orderkey", "l_linenumber")
    c = F.col("c")
    cat = t("part").where("p_size % 10 <> 9").select((F.col("p_size") % 50).alias("c")).distinct()
    courses = cat.select(_code(c).alias("course"), F.when(c % 11 != 5, 2 + c % 5).alias("points"))
    a, b = (F.format_string("W%d", 1000 + F.expr(x)) for x in ("c div 2", "c * 2 div 3"))
    kind = c % 4
    text = (
        F.when(kind == 1, F.concat(a, F.lit(" or "), b, F.lit(".")))
        .when(kind == 2, F.concat(a, F.lit(" and "), b, F.lit(", or permission of the instructor.")))
        .when(kind == 3, F.concat(F.lit("Prerequisite: "), a, F.lit(". Corequisite: "), b, F.lit(".")))
    )
    parsed = pre.parse(cat.select(_code(c).alias("course"), text.alias("text")), "text", F.lit("PART"))
    near = cat.where("c % 7 < 2").select(_code(c).alias("course"), _code(F.when(c % 7 == 0, c + 1).otherwise(c - 1)).alias("other"))
    return plan, courses, parsed, near


@query(f"""
with {_PLAN} select cust, term::bigint as term, place::bigint as place, 'PART' || (1000 + c) || 'W' as course, kind, severity, array_to_string(list_transform(o, lambda v: 'PART' || (1000 + v) || 'W'), ' ') as resolved_by, 'PART' || (1000 + other) || 'W' as other from issues
""")
def g22_issues(spark, t):
    """Everything that is wrong with everyone's plan, term by term."""
    got = plan_check.check_plans(*_plans(t), "cust", "term", "place", "course", max_depth=2)
    return got.select("cust", F.col("term").cast("long").alias("term"), F.col("place").cast("long").alias("place"), "course", "kind", "severity", F.array_join("resolved_by", " ").alias("resolved_by"), "other")
