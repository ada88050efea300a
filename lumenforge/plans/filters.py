"""Queries of predicates (F), projections (P) and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.functions import scalar
from lumenforge.plans.registry import query

_STATUS = "case event_type when 'error' then 'closed' when 'click' then 'full' when 'view' then 'open' when 'signup' then 'waitlist' end"


def _seats(t):
    status = F.when(F.col("event_type") == "error", "closed").when(F.col("event_type") == "click", "full").when(F.col("event_type") == "view", "open").when(F.col("event_type") == "signup", "waitlist")
    count = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return t("events"), status, count, F.lit(60.0)


@query(f"""
with e as (select event_id, {_STATUS} as st, case when event_id % 5 <> 0 then value end as c, 60.0 as cap from events)
select event_id,
 case when st in ('closed', 'full') then false when st = 'open' then true else coalesce(c < cap, false) end as by_status,
 case when st in ('closed', 'full') then false when c is null then coalesce(st = 'open', false) else c < cap end as by_count,
 case when st in ('closed', 'full', 'waitlist') then false when c is not null then c < cap when st = 'open' then true end as tristate from e
""")
def f15_f17_open_seats(spark, t):
    e, s, c, cap = _seats(t)
    return e.select("event_id", scalar.open_seat_by_status(s, c, cap).alias("by_status"), scalar.open_seat_by_count(s, c, cap).alias("by_count"), scalar.open_seat_tristate(s, c, cap).alias("tristate"))


@query("select p_partkey from part where p_brand in ('Brand#7', 'Brand#11') and p_type in ('PROMO', 'SMALL') and p_size between 5 and 30")
def f1_f3_facets(spark, t):
    return t("part").where(F.col("p_brand").isin("Brand#7", "Brand#11") & F.col("p_type").isin("PROMO", "SMALL") & F.col("p_size").between(5, 30)).select("p_partkey")


@query("""
with r as (select l_orderkey, min(round(l_quantity * 4) / 4) as lo, max(round(l_quantity * 4) / 4) as hi from lineitem group by 1) select l_orderkey from r where hi >= 20 and lo <= 22
""")
def f4_interval_overlap(spark, t):
    q = F.round(F.col("l_quantity") * 4) / 4
    return t("lineitem").groupBy("l_orderkey").agg(F.min(q).alias("lo"), F.max(q).alias("hi")).where("hi >= 20 and lo <= 22").select("l_orderkey")


@query("""
with f as (select l_orderkey, list(distinct l_returnflag) as flags from lineitem group by 1)
select l_orderkey, list_has_any(flags, ['R', 'Z']) as any_flag, list_has_all(flags, ['R', 'A']) as all_flags, list_has_all(['R', 'A'], flags) as within_flags from f
""")
def f5_f7_set_filters(spark, t):
    f = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    sel = F.array(F.lit("R"), F.lit("A"))
    return f.select("l_orderkey", F.arrays_overlap("flags", F.array(F.lit("R"), F.lit("Z"))).alias("any_flag"), (F.size(F.array_except(sel, "flags")) == 0).alias("all_flags"), (F.size(F.array_except("flags", sel)) == 0).alias("within_flags"))


@query("select c_custkey from customer left join (select doc_id, max(quality) as q from labels group by 1) on doc_id = c_custkey where coalesce(q >= 1, true)")
def f11_reputation_filter(spark, t):
    q = t("labels").groupBy(F.col("doc_id").alias("c_custkey")).agg(F.max("quality").alias("q"))
    return t("customer").join(q, "c_custkey", "left").where(F.coalesce(F.col("q") >= 1, F.lit(True))).select("c_custkey")


@query("select l_orderkey, list_sort(list(l_linenumber) filter (where l_quantity > 40)) as matched from lineitem group by 1")
def f13_matched_children(spark, t):
    m = F.sort_array(F.collect_list(F.when(F.col("l_quantity") > 40, F.col("l_linenumber"))))
    return t("lineitem").groupBy("l_orderkey").agg(m.alias("m")).select("l_orderkey", F.when(F.size("m") > 0, F.col("m")).alias("matched"))


@query("select p_partkey from part where p_partkey not in (5, 17) and (p_partkey in (1, 2, 17) or (p_brand = 'Brand#17' and p_size between 20 and 40))")
def f18_selector(spark, t):
    shape = (F.col("p_brand") == "Brand#17") & F.col("p_size").between(20, 40)
    return t("part").where(~F.col("p_partkey").isin(5, 17) & (F.col("p_partkey").isin(1, 2, 17) | shape)).select("p_partkey")


@query("""
select page_id, exists (select 1 from unnest(['example.com', 'example.org']) h(x) where host = x or ends_with(host, '.' || x)) as allowed from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) as host from pages)
""")
def f21_host_allow_list(spark, t):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1))
    allowed = F.exists(F.array(F.lit("example.com"), F.lit("example.org")), lambda x: (F.col("host") == x) | F.endswith(F.col("host"), F.concat(F.lit("."), x)))
    return t("pages").withColumn("host", host).select("page_id", allowed.alias("allowed"))


@query("select c_custkey, regexp_matches(c_name, '^Customer#[0-9]{9}$') and c_mktsegment is not null as valid from customer")
def f22_identity_check(spark, t):
    return t("customer").select("c_custkey", (F.col("c_name").rlike("^Customer#[0-9]{9}$") & F.col("c_mktsegment").isNotNull()).alias("valid"))


@query("select event_id, json_keys(props) = ['k'] as shaped from events")
def f23_json_shape(spark, t):
    return t("events").select("event_id", (F.json_object_keys("props") == F.array(F.lit("k"))).alias("shaped"))


@query("select l_orderkey, len(list(l_partkey)) <> len(list(distinct l_partkey)) as repeats from lineitem group by 1")
def f24_array_duplicates(spark, t):
    a = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("a"))
    return a.select("l_orderkey", (F.size("a") != F.size(F.array_distinct("a"))).alias("repeats"))


@query("select doc_id, trim(regexp_replace(lower(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '[^a-z0-9]+', ' ', 'g')) as folded from documents")
def x1_fold_all(spark, t):
    """Whole texts folded."""
    return t("documents").select("doc_id", scalar.fold(F.col("text")).alias("folded"))


@query("select p_partkey, replace(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' ', '-') as slug from part")
def p_slugs(spark, t):
    return t("part").select("p_partkey", scalar.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("select p_partkey, p_name, case when regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') <> '' and not starts_with(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g')) then p_type end as distinct_title from part")
def p2_distinct_titles(spark, t):
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return t("part").select("p_partkey", "p_name", F.when((plain("p_type") != "") & ~F.startswith(plain("p_name"), plain("p_type")), F.col("p_type")).alias("distinct_title"))


@query("select event_id, (hour(ts) * 60 + minute(ts))::bigint as m, format('{}:{:02d} {}', case when hour(ts) % 12 = 0 then 12 else hour(ts) % 12 end, minute(ts), case when hour(ts) < 12 then 'am' else 'pm' end) as label from events")
def p_minute_labels(spark, t):
    m = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return t("events").select("event_id", m.alias("m"), scalar.minutes_label(m).alias("label"))


@query("select p_partkey, left(concat_ws('. ', p_name || ' ' || p_brand, p_type), 6000) as document from part")
def p5_search_document(spark, t):
    return t("part").select("p_partkey", F.left(F.concat_ws(". ", F.concat_ws(" ", "p_name", "p_brand"), "p_type"), F.lit(6000)).alias("document"))


@query("""
with p as (select n_nationkey, n_nationkey * 2.0 - 25 as lat, n_nationkey * 3.5 - 40 as lng from nation)
select a.n_nationkey as a, b.n_nationkey as b, round(2 * 6371000 * asin(sqrt(least(1.0, power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2)))), 2) as metres
from p a join p b on b.n_nationkey = a.n_nationkey + 1
""")
def g21_commute_distance(spark, t):
    p = t("nation").select("n_nationkey", (F.col("n_nationkey") * 2.0 - 25).alias("lat"), (F.col("n_nationkey") * 3.5 - 40).alias("lng"))
    b = p.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_nationkey").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return p.join(b, "n_nationkey").select(F.col("n_nationkey").alias("a"), "b", F.round(scalar.haversine_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 2).alias("metres"))


@query("select doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '')) as token from documents")
def s_token_hash(spark, t):
    return t("documents").select("doc_id", F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit(""))), 256).alias("token"))
