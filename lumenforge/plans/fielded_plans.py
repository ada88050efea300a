"""Queries of the fielded index (X3, X4, X5, X8, X15, X22, X23, O3, O4) on parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenforge.operators import fielded, search, search_index
from lumenforge.plans.registry import query

_SPLIT = "list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
_INDEX = f"""
w as (select p_partkey as doc, unnest({_SPLIT.format('p_name')}) as term, 1 as bit from part union all select p_partkey, unnest(['part', p_partkey::varchar, 'part' || p_partkey]), 2 from part
 union all select p_partkey, unnest(['brand', substr(p_brand, 7)]), 4 from part where p_brand like 'Brand#%' union all select p_partkey, unnest({_SPLIT.format('p_type')}), 8 from part),
p as (select doc, term, count(*) as tf, bit_or(bit) as mask from w group by all), l as (select doc, sum(tf) as dl from p group by 1),
c as (select count(*) as n, (select sum(dl) from l) / count(*)::double as avgdl from part), f as (select term, count(*) as df from p group by 1)
"""
_BOOST = "greatest(case when mask & 1 > 0 then 4.0 else 0 end, case when mask & 2 > 0 then 6.0 else 0 end, case when mask & 4 > 0 then 2.5 else 0 end, case when mask & 8 > 0 then 1.0 else 0 end)"
_SCORE = f"ln(1 + (n - df + 0.5) / (df + 0.5)) * wt * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * {_BOOST}"
_HITS = f"""
r as (select term, df, 1.0 as wt, 1 as bit from f where term = 'crimson' union all select term, df, 0.7, 1 from f where term = 'red' union all select term, df, 0.25, 2 from f where term = 'the'
 union all select term, df, 0.6, 4 from f where starts_with(term, 'widg')),
h as (select doc, {_SCORE} as s, r.bit from p join r using (term) join l using (doc), c union all select doc, 250.0, 7 from p where term = 'part77'),
need as (select coalesce(bit_or(bit), 0) as need from r where bit <> 2),
hits as (select doc, sum(s) as score from h group by doc having bit_or(bit) & (select need from need) = (select need from need))
"""


def _index(t):
    """The stored index of parts: the first query over a table writes it, later ones read it."""
    parts = t.dealt("part").select("p_partkey", "p_name", "p_brand", "p_type")  # a part becomes some fifteen postings
    code = F.concat_ws(" ", F.concat(F.lit("part"), F.col("p_partkey")))
    fields = {"title": F.col("p_name"), "code": code, "instructor": F.col("p_brand"), "body": F.col("p_type")}
    return search_index.stored_index(parts, "p_partkey", fields, t.folder("search"), "parts")


def _answer(t):
    return search_index.answer(_index(t), _PARSED.groups, _PARSED.codes)


_PARSED = fielded.Parsed("crimson the widg", (search.Group([("crimson", 1.0), ("red", 0.7)]), search.Group([("the", 0.25)]), search.Group([("widg", 1.0)], prefix=True)), ("part77",))


@query(f"with {_INDEX} select doc, term, tf, mask::bigint as mask, dl::bigint as doc_length from p join l using (doc)")
def x5_fielded_postings(spark, t):
    """Postings with a bit for each field."""
    return _index(t).postings.select("doc", "term", "tf", "mask", "doc_length")


@query(f"with {_INDEX}, {_HITS} select doc, round(score, 6) as score from hits")
def x8_fielded(spark, t):
    """Boosted BM25 over fields, variants, a prefix and a code."""
    return _answer(t).select("doc", F.round("score", 6).alias("score"))


@query(f"""
with {_INDEX}, {_HITS}, q as (select embedding as e from embeddings where vec_id = 1),
s as (select vec_id as doc, 1 - 2 * list_sum(list_transform(range(1, 65), lambda i: case when (embedding[i] > 0) <> (q.e[i] > 0) then 1 else 0 end)) / 64.0 as sim from embeddings, q)
select doc, round(score + 12 * coalesce(sim, 0), 6) as score from hits left join s using (doc)
""")
def x15_fused(spark, t):
    """Similarity of sign codes added to what the words found."""
    codes = t("embeddings").select(F.col("vec_id").alias("doc"), search.sign_code(F.col("embedding"), 64).alias("code"))
    own = codes.where("doc = 1").select("code").first()  # the query's one vector
    return fielded.fused(_answer(t), codes, own.code if own else [0], 64).select("doc", F.round("score", 6).alias("score"))


@query(f"""
with {_INDEX}, {_HITS}, seats as (select l_partkey as doc, bool_or(l_returnflag = 'N') as value from lineitem group by 1), rep as (select doc_id as doc, max(quality) as value from labels group by 1)
select doc, round(score, 6) as score, seats.value as open_seats, rep.value::double as reputation from hits left join seats using (doc) left join rep using (doc)
""")
def x23_overlaid(spark, t):
    """Seats and reputation laid over what was found."""
    seats = t("lineitem").groupBy(F.col("l_partkey").alias("doc")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("value"))
    rep = t("labels").groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").cast("double").alias("value"))
    return fielded.overlaid(_answer(t), {"open_seats": seats, "reputation": rep}).withColumn("score", F.round("score", 6))


@query("""
with d as (select doc_id, regexp_extract_all(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '\\b[a-z]{2,4}\\s?[a-z]?\\s?[0-9]{3,4}\\b') as hits from documents)
select doc_id, coalesce(len(hits), 0)::bigint as n_codes from d
""")
def x3_codes_in_texts(spark, t):
    """How many course codes each text names."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    found = F.regexp_extract_all(plain, F.lit(r"\b[a-z]{2,4}\s?[a-z]?\s?[0-9]{3,4}\b"), 0)
    return t("documents").select("doc_id", F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_codes"))


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_brand), 'red') and p_type in ('PROMO') and p_size >= 10 order by p_partkey")
def x22_substring_search(spark, t):
    """The plain fallback: a substring and every requirement, in the order of ids."""
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return t("part").where(hay.contains("red") & (F.col("p_type") == "PROMO") & (F.col("p_size") >= 10)).select("p_partkey").orderBy("p_partkey")


@query("select p_partkey, -p_size::bigint as score, row_number() over (order by -p_size desc, p_brand, p_partkey) as place from part qualify place <= 100")
def o3_o4_unqueried_order(spark, t):
    """Without a query the score is minus the number; then subject, then number; the first hundred."""
    score = (-F.col("p_size")).cast("long")
    top = t("part").select("p_partkey", "p_brand", score.alias("score")).orderBy(F.desc("score"), "p_brand", "p_partkey").limit(100)
    return top.select("p_partkey", "score", F.row_number().over(Window.orderBy(F.desc("score"), "p_brand", "p_partkey")).cast("long").alias("place"))
