"""Full-text and vector queries (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.operators import lsa, search, search_index
from lumenforge.plans.registry import query

_WORDS = "list_filter(string_split(trim(regexp_replace(translate(lower(p_name || ' ' || p_brand), 'é', 'e'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("select c_custkey, length(c_name) as n, list_filter(string_split(trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') as words from customer")
def x2_tokens(spark, t):
    return t("customer").select("c_custkey", F.length("c_name").cast("long").alias("n"), search.tokens(F.col("c_mktsegment")).alias("words"))


@query(f"with w as (select p_partkey, unnest({_WORDS}) as term from part) select term, count(distinct p_partkey) as df from w group by 1")
def x5_document_frequency(spark, t):
    docs = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return search.postings(docs, "p_partkey", "text").groupBy("term").agg(F.count("*").alias("df"))


@query(f"""
with d as (select p_partkey as doc, {_WORDS} as w from part), c as (select count(*) as n, avg(len(w)) as avgdl from d),
tf as (select doc, term, count(*) as tf, dl from (select doc, len(w) as dl, unnest(w) as term from d) group by all), f as (select term, count(*) as df from tf group by 1)
select doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join f using (term), c where term in ('red', 'widget') group by doc having count(*) = 2
""")
def x8_bm25(spark, t):
    docs = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return search.bm25(docs, "p_partkey", "text", ["red", "widget"]).select("doc", F.round("score", 6).alias("score"))


@query(f"""
with w as (select p_partkey, unnest({_WORDS}) as term from part), f as (select term, count(distinct p_partkey) as df from w group by 1)
select term, df, case when term = 'r' then 1.0 else 0.6 end as weight from f where starts_with(term, 'r') order by df desc, term limit 24
""")
def x11_prefix(spark, t):
    docs = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return search.prefix_terms(search.postings(docs, "p_partkey", "text").groupBy("term").agg(F.count("*").alias("df")), "r")


@query(f"""
with w as (select p_partkey, unnest({_WORDS}) as term from part), f as (select term, count(distinct p_partkey) as df from w group by 1)
select term, df, levenshtein(term, 'wigdet') as distance, [1.0, 0.55, 0.3][levenshtein(term, 'wigdet') + 1]::double as weight from f where abs(length(term) - 6) <= 2 and levenshtein(term, 'wigdet') between 1 and 2 order by 3, df desc, term limit 6
""")
def x12_fuzzy(spark, t):
    docs = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return search.fuzzy_terms(search.postings(docs, "p_partkey", "text").groupBy("term").agg(F.count("*").alias("df")), "wigdet")


@query("""
select p_partkey, case when n = 2 then 60.0 else 60.0 * n / 2 / 2 end + case when starts_with(p_name, 'red widget') then 35.0 else 0.0 end as boost from (select p_partkey, p_name, list_contains(string_split(p_name, ' '), 'red')::bigint + list_contains(string_split(p_name, ' '), 'widget')::bigint as n from part)
""")
def x14_title_boost(spark, t):
    return t("part").select("p_partkey", search.title_boost(F.col("p_name"), "red widget").alias("boost"))


@query("""
select vec_id, list_sum(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then 1 else 0 end))::bigint as ones from embeddings
""")
def x16_sign_codes(spark, t):
    code = search.sign_code(F.col("embedding"), 64)
    return t("embeddings").select("vec_id", F.aggregate(code, F.lit(0).cast("long"), lambda s, v: s + F.bit_count(v)).alias("ones"))


@query("""
with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select vec_id, 1 - 2 * list_sum(list_transform(range(1, 65), lambda i: case when (embedding[i] > 0) <> (q.e[i] > 0) then 1 else 0 end)) / 64.0 as sim from embeddings, q)
select vec_id, sim from s order by sim desc, vec_id limit 200
""")
def x15_code_similarity(spark, t):
    e = t("embeddings").select("vec_id", search.sign_code(F.col("embedding"), 64).alias("code"))
    q = e.orderBy("vec_id").limit(1).select(F.col("code").alias("q"))
    sim = search.code_similarity(F.col("code"), F.col("q"), 64)
    return e.join(F.broadcast(q)).select("vec_id", sim.alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(200)


@query("""
with q as (select embedding as e from embeddings order by vec_id limit 1), s as (select vec_id, list_cosine_similarity(embedding::double[], q.e::double[]) as sim from embeddings, q)
select vec_id, round(sim, 6) as sim from s order by sim desc, vec_id limit 25
""")
def x19_cosine_top_k(spark, t):
    e = t("embeddings").select("vec_id", "embedding")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    top = e.join(F.broadcast(q)).select("vec_id", search.cosine(F.col("embedding"), F.col("q")).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(25)
    return top.select("vec_id", F.round("sim", 6).alias("sim"))


@query("""
select p_partkey, score from (select p_partkey, p_name, case when p_name = 'red widget' then 300 when starts_with(p_name, 'red') then 120 else 60 end + case when p_brand = 'Brand#7' then 25 else 0 end + 5 as score from part where contains(p_name, 'red') or contains(p_name, 'widget')) order by score desc, p_partkey limit 50
""")
def x20_local_scorer(spark, t):
    n = F.col("p_name")
    score = F.when(n == "red widget", 300).when(n.startswith("red"), 120).otherwise(60) + F.when(F.col("p_brand") == "Brand#7", 25).otherwise(0) + 5
    return t("part").where(n.contains("red") | n.contains("widget")).select("p_partkey", score.cast("long").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("""
select p_partkey, rank, length(p_name) as len from (select p_partkey, p_name, case when p_name = 'small ring' then 0 when starts_with(p_name, 'small') then 1 else 2 end as rank from part where contains(p_name, 'small') or contains(p_name, 'ring')) order by rank, len, p_partkey limit 20
""")
def x21_onboarding_search(spark, t):
    n = F.col("p_name")
    rank = F.when(n == "small ring", 0).when(n.startswith("small"), 1).otherwise(2)
    return t("part").where(n.contains("small") | n.contains("ring")).select("p_partkey", rank.cast("long").alias("rank"), F.length(n).cast("long").alias("len")).orderBy("rank", "len", "p_partkey").limit(20)


@query(f"""
with d as (select p_partkey as doc, {_WORDS} as w from part), c as (select count(*) as n, avg(len(w)) as avgdl from d where len(w) > 0),
tf as (select doc, term, count(*) as tf, dl from (select doc, len(w) as dl, unnest(w) as term from d) group by all), f as (select term, count(*) as df from tf group by 1),
r as (select term, df, 1.0 as wt, 1 as bit from f where term = 'red' union all select term, df, 0.85, 1 from f where term = 'green'
  union all (select term, df, 0.6, 2 from f where starts_with(term, 'widg') order by df desc, term limit 24)
  union all (select term, df, [1.0, 0.55, 0.3][levenshtein(term, 'golb') + 1], 4 from f where abs(length(term) - 4) <= 1 and levenshtein(term, 'golb') = 1 order by df desc, term limit 6)),
need as (select coalesce(bit_or(bit), 0) as need from r where bit in (1, 2)),
h as (select doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * wt * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s, bit from tf join r using (term), c union all select doc, 250.0, 7 from tf where term = '12')
select doc, round(sum(s), 6) as score from h group by doc having bit_or(bit) & (select need from need) = (select need from need)
""")
def x9_ranked(spark, t):
    index = search_index.stored_index(t("part").select("p_partkey", "p_name", "p_brand"), "p_partkey", {"title": F.concat_ws(" ", "p_name", "p_brand")}, t.folder("search"), "titles")
    groups = [search.Group([("red", 1.0), ("green", 0.85)]), search.Group([("widg", 1.0)], prefix=True, fuzzy=True), search.Group([("golb", 0.25)], fuzzy=True), search.Group([("zzzzzzzz", 1.0)], prefix=True, fuzzy=True)]
    return search_index.answer(index, groups, ["12"], boosted=False).select("doc", F.round("score", 6).alias("score"))


@query(f"""
with d as (select p_partkey as doc, {_WORDS} as w from part), c as (select count(*) as n, avg(len(w)) as avgdl from d where len(w) > 0),
tf as (select doc, term, count(*) as tf, dl from (select doc, len(w) as dl, unnest(w) as term from d) group by all), f as (select term, count(*) as df from tf group by 1),
k as (select *, row_number() over (partition by term order by doc) as place from tf where term in ('red', 'green', '12', 'brand')),
w as (select doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as w from k join f using (term), c where place <= 2048 and df * 2 <= n group by 1),
s as (select generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double * w as x from embeddings join w on vec_id = doc), t as (select pos, sum(x) as s from s group by 1)
select pos, round(s / (select sqrt(sum(s * s)) from t), 6) as value from t
""")
def x17_fold_in(spark, t):
    docs = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    got = search.fold_in(search.postings(docs, "p_partkey", "text"), t("embeddings"), "vec_id", "embedding", ["red", "green", "12", "brand", "red", "zzzz"])
    return got.select("pos", F.round("value", 6).alias("value"))


@query("""
with e as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings)
select vec_id, case when top > 0 then top / 127 else 1.0 end as scale, list_sum(list_transform(v, lambda x: greatest(-127, least(127, floor(x / (case when top > 0 then top / 127 else 1.0 end) + 0.5)))))::bigint as total,
 list_max(list_transform(v, lambda x: abs(greatest(-127, least(127, floor(x / (case when top > 0 then top / 127 else 1.0 end) + 0.5))))))::bigint as largest from e
""")
def x16_byte_codes(spark, t):
    e = t("embeddings").select("vec_id", search.byte_code(F.col("embedding")).alias("c"))
    total = F.aggregate("c.values", F.lit(0).cast("long"), lambda s, v: s + v)
    return e.select("vec_id", "c.scale", total.alias("total"), F.array_max(F.transform("c.values", lambda v: F.abs(v.cast("long")))).alias("largest"))


@query("""
with e as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) / 127 as scale from embeddings where len(embedding) = 64),
c as (select vec_id, v, list_transform(v, lambda x: greatest(-127, least(127, floor(x / scale + 0.5)))) as b, list_transform(v, lambda x: x > 0) as s from e), q as (select vec_id as query, v as qv, s as qs from c where vec_id % 50 = 0),
f as (select query, vec_id as id, b, qv, 1 - 2 * list_sum(list_transform(range(1, 65), lambda i: case when s[i] <> qs[i] then 1 else 0 end)) / 64.0 as first from c, q),
n as (select * from (select *, row_number() over (partition by query order by first desc, id) as place from f) where place <= 200),
r as (select query, id, list_dot_product(b, qv) / sqrt(list_dot_product(b, b)) as sim from n)
select query, id, round(sim, 9) as sim from (select *, row_number() over (partition by query order by sim desc, id) as place from r) where place <= 10
""")
def x15_rescored(spark, t):
    """The ten nearest rows to every fiftieth row, by sign codes and then by byte codes."""
    e = t("embeddings")
    return search.nearest_by_codes(e, e.where("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", 64, 10).withColumn("sim", F.round("sim", 9))


_FOLDED = "list_filter(string_split(trim(regexp_replace(lower(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
_DOC_WORDS = f"flatten(list_transform({_FOLDED}, lambda w: case when regexp_matches(w, '[a-z]') and regexp_matches(w, '[0-9]') then list_prepend(w, regexp_extract_all(w, '[a-z]+|[0-9]+')) else [w] end))"


@query(f"""
with w as (select doc_id as doc, unnest({_DOC_WORDS}) as term from documents), p as (select doc, term, count(*) as tf from w group by all), n as (select count(*) as n from documents),
d as (select term, count(*) as df from p group by 1 having count(*) between 3 and greatest(3, (select floor(n * 0.4) from n))),
x as (select doc, term, (1 + ln(tf)) * ln(1 + n::double / (1 + df)) as w from p join d using (term), n)
select doc, count(*) as terms, round(max(w) / sqrt(sum(w * w)), 9) as largest, round(sum(w) / sqrt(sum(w * w)), 6) as total from x group by 1
""")
def x18_term_weights(spark, t):
    """What latent semantic vectors are made of: the weighted terms of each document, summed up."""
    docs = t("documents")
    w = lsa.term_weights(search.postings(docs, "doc_id", "text"), docs.count())
    return w.groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 9).alias("largest"), F.round(F.sum("weight"), 6).alias("total"))


@query()
def x18_lsa_vectors(spark, t):
    """Latent semantic vectors of all documents; tests hold their cosines against a full decomposition."""
    docs = t("documents").select("doc_id", "text").repartition(t.parts("documents"), "doc_id")  # texts are smaller than their postings, which then need no shuffle by document
    return lsa.lsa_vectors(search.postings(docs, "doc_id", "text"), docs, "doc_id", dims=64)
