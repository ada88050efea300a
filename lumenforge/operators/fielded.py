"""An index with fields: postings with the fields a term stands in, parsed queries, boosted scores, fusion and overlays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.scalar import tokens
from lumenforge.operators import search

#: Boosts of the fields, in the order of their bits; fixed values.
FIELDS = {"title": 4.0, "code": 6.0, "instructor": 2.5, "body": 1.0}
ALIAS_WEIGHT, ABBREVIATION_WEIGHT, LOW_WEIGHT = 0.85, 0.7, 0.25
MIN_PREFIX, MIN_FUZZY = 2, 4
MAX_TF = 255
#: Words of a body that the other fields do not have, of which the first so many are indexed.
BODY_TERMS = 140
#: Words that say little in a query; fixed values.
LOW_SIGNAL = frozenset("a an and the of to in for on with or at by from as is are be this that it its will i ii iii iv".split())
#: The written shapes of a course code in folded text; fixed pattern.
CODE = r"\b([a-z]{2,4})\s?([a-z])?\s?(\d{3,4})\b\s?([a-z])?\b"


@dataclass(frozen=True)
class Parsed:
    """A query's groups, for ``search.ranked`` and ``scored``, and the codes it names."""

    folded: str
    groups: tuple[search.Group, ...]
    codes: tuple[str, ...]


def _folded(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def _words(folded: str) -> list[str]:
    out = []
    for w in folded.split():
        runs = re.findall("[a-z]+|[0-9]+", w)
        out += [w, *(runs if len(runs) > 1 else [])]
    return list(dict.fromkeys(out))


def codes_of(folded: str, aliases: Mapping[str, Sequence[str]]) -> tuple[str, ...]:
    """The codes that a folded query names: plain, with the letter written with it, and under the subject's other names."""
    found = []
    for subject, before, number, after in re.findall(CODE, folded):
        letter = before or after
        found += [subject + number, *([subject + letter + number] if letter else []), *[a + number for a in aliases.get(subject, ())]]
    return tuple(dict.fromkeys(found))


def parse_query(text: str, aliases: Mapping[str, Sequence[str]] | None = None, abbreviations: Mapping[str, Sequence[str]] | None = None, completed: bool = False) -> Parsed:
    """A typed query as groups: each word with its other names and what it stands for, weighted; an unfinished last word may be a prefix.

    Words that say little weigh 0.25 and need not be found. Words of four and more characters that are not numbers may be misspelt.
    """
    aliases, abbreviations = aliases or {}, abbreviations or {}
    folded = _folded(text)
    words = _words(folded)
    is_open = not completed and text[-1:].isascii() and text[-1:].isalnum()

    def group(word: str) -> search.Group:
        low = word in LOW_SIGNAL
        others = [(a, ALIAS_WEIGHT) for a in aliases.get(word, ())] + [(a, ABBREVIATION_WEIGHT) for a in abbreviations.get(word, ())]
        variants = [(word, LOW_WEIGHT if low else 1.0), *[(a, w) for a, w in others if a != word]]
        return search.Group(variants, prefix=is_open and word == words[-1] and len(word) >= MIN_PREFIX, fuzzy=not low and len(word) >= MIN_FUZZY and not word.isdigit())

    return Parsed(folded, tuple(map(group, words)), codes_of(folded, aliases))


def fielded_postings(docs: DataFrame, id_col: str, fields: Mapping[str, Column]) -> DataFrame:
    """(doc, term, tf, mask, doc_length) of documents with text columns for some of ``FIELDS``; null fields are empty.

    ``mask`` has a bit for each field that the term stands in. A body adds its first BODY_TERMS new words, as defined; words that other
    fields have count in it as well. ``search_index`` writes what this gives and answers queries from it.
    """
    bits = {name: 1 << i for i, name in enumerate(FIELDS)}
    words = {f: F.coalesce(tokens(c), F.array().cast("array<string>")) for f, c in fields.items()}
    docs = docs.select(F.col(id_col), *(w.alias(f"_{f}") for f, w in words.items()))
    if "body" in words:
        other = F.flatten(F.array(F.array().cast("array<string>"), *(F.col(f"_{f}") for f in words if f != "body")))
        kept = F.slice(F.array_except("_body", other), 1, BODY_TERMS)  # distinct, in the order of the text
        long = F.size("_body") > BODY_TERMS
        docs = docs.withColumn("_kept", F.when(long, F.concat(kept, other))).withColumn("_body", F.when(long, F.filter("_body", lambda w: F.array_contains("_kept", w))).otherwise(F.col("_body")))

    def marked(field: str) -> Column:
        return F.transform(F.col(f"_{field}"), lambda w: F.struct(w.alias("term"), F.lit(bits[field]).cast("long").alias("bit")))

    each = [marked(f) for f in words]
    words = docs.select(F.col(id_col).alias("doc"), F.explode(F.concat(*each)).alias("w")).select("doc", "w.*")
    post = words.groupBy("doc", "term").agg(F.least(F.count("*"), F.lit(MAX_TF)).cast("long").alias("tf"), F.bit_or("bit").alias("mask"))
    length = post.groupBy("doc").agg(F.sum("tf").alias("doc_length"))
    return post.join(length, "doc")


def totals(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row: n_docs, those without a term included, and the mean length over them."""
    per_doc = post.groupBy("doc").agg(F.first("doc_length").alias("n"))
    return docs.agg(F.count("*").alias("n_docs")).join(F.broadcast(per_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_sum")))).select("n_docs", (F.col("_sum") / F.greatest("n_docs", F.lit(1))).alias("avg_length"))


def boost(mask: Column) -> Column:
    """The largest boost of the fields in a mask."""
    return F.greatest(F.lit(0.0), *[F.when(mask.bitwiseAND(1 << i) > 0, b).otherwise(0.0) for i, b in enumerate(FIELDS.values())])


def scored(post: DataFrame, totals_row: DataFrame, parsed: Parsed) -> DataFrame:
    """(doc, score) of a parsed query over fielded postings: BM25 by field boost, and ``search.CODE_BOOST`` for each code a document has.

    Every group that weighs fully and found a term must hit, unless a code does. An empty query finds nothing.
    """
    vocabulary = post.groupBy("term").agg(F.count("*").alias("df"))
    terms = search.resolved_terms(vocabulary, parsed.groups)  # a bounded number a group
    bit = F.expr("shiftleft(1L, grp)")
    one = search.idf(F.col("n_docs"), F.col("df")) * F.col("weight") * search.tf_part(F.col("tf"), F.col("doc_length"), F.col("avg_length")) * boost(F.col("mask"))
    hits = post.join(F.broadcast(terms), "term").join(F.broadcast(totals_row)).select("doc", one.alias("score"), bit.alias("groups"))
    exact = post.where(F.col("term").isin(*parsed.codes) if parsed.codes else F.lit(False)).select("doc", F.lit(search.CODE_BOOST).alias("score"), F.lit(-1).cast("long").alias("groups"))
    full = [g for g, x in enumerate(parsed.groups) if x.variants[0][1] >= 1]
    need = terms.where(F.col("grp").isin(*full) if full else F.lit(False)).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("need"))
    out = hits.unionByName(exact).groupBy("doc").agg(F.sum("score").alias("score"), F.bit_or("groups").alias("groups"))
    return out.join(F.broadcast(need)).where(F.col("groups").bitwiseAND(F.col("need")) == F.col("need")).select("doc", "score")


def fused(hits: DataFrame, codes: DataFrame, query_code: Sequence[int], dims: int, weight: float = search.SEMANTIC_WEIGHT) -> DataFrame:
    """Adds the weighted similarity of sign codes (doc, code) to documents that were found; it finds no others, and those without a code keep their score."""
    q = F.array(*[F.lit(int(x)).cast("long") for x in query_code])
    near = codes.select("doc", search.code_similarity(F.col("code"), q, dims).alias("_sim"))
    return hits.join(near, "doc", "left").select("doc", (F.col("score") + weight * F.coalesce("_sim", F.lit(0.0))).alias("score"))


def overlaid(hits: DataFrame, overlays: Mapping[str, DataFrame]) -> DataFrame:
    """Adds each overlay (doc, value) as a column of its name; documents that it does not have get null, which filters read as unknown."""
    for name, rows in overlays.items():
        hits = hits.join(rows.select("doc", F.col("value").alias(name)), "doc", "left")
    return hits
