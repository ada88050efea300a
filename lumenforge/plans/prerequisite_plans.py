"""Prerequisites (G1, G2, G3, G8, G9) on texts laid out from parts, with customers' orders as completed courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.operators import audits
from lumenforge.operators import prerequisites as pre
from lumenforge.plans.registry import query

# Three kinds of text: (A or B) and C; A, B or permission; A and B and something else.
_CODES = "'COMS' || (1000 + p_partkey % 50) || 'W' as a, 'MATH' || (1000 + p_size % 50) || 'V' as b, 'COMS' || (1000 + (p_partkey + 7) % 50) || 'W' as c, p_size % 3 as k"
_DONE = "select distinct o_custkey, (case when o_orderkey % 100 < 50 then 'COMS' || (1000 + o_orderkey % 50) || 'W' else 'MATH' || (1000 + o_orderkey % 50) || 'V' end) as code from orders"


def _parsed(t, *more):
    a, b, c = F.format_string("COMS W%d", 1000 + F.col("p_partkey") % 50), F.format_string("math V%d", 1000 + F.col("p_size") % 50), F.format_string("W%d", 1000 + (F.col("p_partkey") + 7) % 50)
    kind = F.col("p_size") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("Prerequisites: ("), a, F.lit(" or "), b, F.lit(") and "), c, F.lit(" and "), a, F.lit(".")))
        .when(kind == 1, F.concat(a, F.lit(", "), b, F.lit(" or permission of the instructor.")))
        .otherwise(F.concat(a, F.lit(" and ("), b, F.lit(") and knowledge of Java, as said")))
    )
    return pre.parse(t.dealt("part").select("p_partkey", text.alias("text"), *more), "text", F.lit("COMS"))  # writing the texts costs more than moving a row


def _done(t):
    n = 1000 + F.col("o_orderkey") % 50
    code = F.when(F.col("o_orderkey") % 100 < 50, F.concat(F.lit("COMS"), n, F.lit("W"))).otherwise(F.concat(F.lit("MATH"), n, F.lit("V")))
    return t("orders").select("o_custkey", code.alias("code")).distinct()


@query(f"""
with p as (select p_partkey, {_CODES} from part)
select p_partkey, k = 1 as permission, case when k = 2 then 'partial' else 'structured' end as confidence,
case k when 0 then 'all(any(' || a || ' ' || b || ') ' || c || ')' when 1 then 'any(' || a || ' ' || b || ')' else 'any(all(' || a || ' ' || b || ' knowledge of Java) as said)' end as tree from p
""")
def g1_prerequisite_trees(spark, t):
    p = _parsed(t)
    n = F.col("nodes")

    def shown(parent, depth):
        def one(x):
            return x["value"] if depth == 0 else F.coalesce(x["value"], F.concat(x["kind"], F.lit("("), F.array_join(shown(x["node"], depth - 1), " "), F.lit(")")))

        return F.transform(F.filter(n, lambda x: x["parent"].eqNullSafe(parent)), one)

    return p.select("p_partkey", "permission", "confidence", shown(F.lit(None), 2)[0].alias("tree"))


@query(f"""
with p as (select p_partkey, {_CODES} from part), d as ({_DONE}), ask as (select distinct o_custkey, l_partkey as p_partkey from orders join lineitem on l_orderkey = o_orderkey),
x as (select ask.o_custkey, p_partkey, k, (o_custkey, a) in (select (o_custkey, code) from d) as ha, (o_custkey, b) in (select (o_custkey, code) from d) as hb, (o_custkey, c) in (select (o_custkey, code) from d) as hc from ask join p using (p_partkey))
select o_custkey, p_partkey,
(case k when 0 then case when (ha or hb) and hc then 2 else 0 end when 1 then case when ha or hb then 2 else 1 end else 1 end)::bigint as status,
(case k when 0 then (not (ha or hb))::int + (not hc)::int when 1 then (not (ha or hb))::int else (not (ha and hb))::int end)::bigint as open_choices from x
""")
def g8_evaluated(spark, t):
    ask = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("l_partkey").alias("p_partkey")).distinct()
    got = pre.judged(ask, _parsed(t), _done(t), "o_custkey", "p_partkey", "code", max_depth=2)
    return got.select("o_custkey", "p_partkey", F.col("status").cast("long").alias("status"), F.size("outstanding").cast("long").alias("open_choices"))


@query(f"""
with p as (select p_partkey, {_CODES} from part), n as (select * from p where k = 0), d as ({_DONE}), adds as (select distinct o_custkey, 'COMS' || (1000 + (o_custkey + 3) % 50) || 'W' as added from orders),
s as (select o_custkey, list(code) as codes from d group by 1),
x as (select adds.o_custkey, added, p_partkey, codes, list_append(codes, added) as more, a, b, c, k from adds join s using (o_custkey) join p on added in (a, b) or k = 0 and added = c)
select o_custkey, added, 'P' || p_partkey as item from x where case k when 0 then not ((list_contains(codes, a) or list_contains(codes, b)) and list_contains(codes, c)) when 1 then not (list_contains(codes, a) or list_contains(codes, b)) else true end
and case k when 0 then (list_contains(more, a) or list_contains(more, b)) and list_contains(more, c) else true end
""")
def g9_newly_unlocked(spark, t):
    adds = t("orders").select("o_custkey", F.format_string("COMS%dW", 1000 + (F.col("o_custkey") + 3) % 50).alias("added")).distinct()
    parsed = _parsed(t).withColumn("item", F.concat(F.lit("P"), "p_partkey"))
    return pre.newly_unlocked(adds, parsed, _done(t), "o_custkey", "item", "code", max_depth=2)


@query("""
with recursive e as (select distinct 'PART' || p_partkey % 97 || 'W' as x, 'PART' || (p_partkey % 97 + p_size % 5) || 'W' as y from part where p_partkey >= 0),
b as (select x as u, y as v from e where x <> y union select y, x from e where x <> y), r as (select u as node, u as other from b union select r.node, v from r join b on b.u = r.other)
select regexp_replace(node, 'PART(\\d+)W', '\\1')::bigint as course, min(regexp_replace(other, 'PART(\\d+)W', '\\1')::bigint) as lowest from r group by 1
""")
def g3_equivalent_courses(spark, t):
    code = F.format_string("%04d", 3000 + F.col("p_partkey") % 97), F.format_string("%04d", 3000 + F.col("p_partkey") % 97 + F.col("p_size") % 5)
    text = F.concat(F.lit("A course. Students may receive credit for only one of the following two courses: PART W"), code[0], F.lit(" or W"), code[1], F.lit("."))
    got = pre.equivalent_pairs(t("part").select(text.alias("text")), "text", F.lit("PART"))
    number = lambda c: (F.regexp_extract(c, r"(\d+)", 1).cast("long") - 3000)
    return got.select(number("course").alias("course"), number("group").alias("lowest"))


@query()
def g23_suggested_plan(spark, t):
    """Every customer's parts planned over eight terms; sequential choices, so tests hold the operator against recomputation."""
    more = (F.col("p_size") % 5 + 1).cast("double").alias("points"), (F.col("p_partkey") % 4).alias("depth"), F.col("p_retailprice").cast("int").alias("fan_out")
    facts = _parsed(t, *more).select("p_partkey", "points", "depth", "fan_out", audits.packed_tree(F.col("nodes")).alias("tree"))
    done = _done(t).groupBy("o_custkey").agg(F.collect_list("code").alias("completed"))
    ask = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("l_partkey").alias("p_partkey")).distinct()
    wanted = ask.join(facts.hint("merge"), "p_partkey").withColumn("course", F.concat(F.lit("P"), "p_partkey"))
    return audits.suggest_plan(wanted, "o_custkey", completed=done)
