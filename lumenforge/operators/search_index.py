"""A search index that is written once and answers many queries: sorted postings, a vocabulary and totals as Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenforge.operators import fielded, search

#: Postings of a part, so that the parts of an index keep one size.
PART_ROWS = 2_000_000


@dataclass(frozen=True)
class Index:
    """``postings`` (doc, term, tf, mask, doc_length) sorted by term, ``vocabulary`` (term, df), and the totals of all documents, those without a term included."""

    postings: DataFrame
    vocabulary: DataFrame
    n_docs: int
    avg_length: float


def write_index(docs: DataFrame, id_col: str, fields: Mapping[str, Column], path: str) -> None:
    """Write an index of ``docs`` with text columns for some of ``fielded.FIELDS`` under ``path``; an index that is there is replaced.

    Postings are dealt by ranges of terms and sorted, so that a query's terms touch few row groups. Frequent terms spread over several parts.
    """
    post = fielded.fielded_postings(docs, id_col, fields)
    post.write.mode("overwrite").parquet(f"{path}/unsorted")
    post = docs.sparkSession.read.parquet(f"{path}/unsorted")
    parts = max(1, -(-post.count() // PART_ROWS))
    post.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    post.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange(max(1, parts // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    fielded.totals(docs, post).write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str, doc: str = "bigint") -> Index:
    """An index that ``write_index`` has finished, of documents with ids of type ``doc``; the totals, written last, are the sign of it."""
    totals = spark.read.schema("n_docs long, avg_length double").parquet(f"{path}/totals").first()
    postings = spark.read.schema(f"doc {doc}, term string, tf bigint, mask bigint, doc_length bigint").parquet(f"{path}/postings")
    return Index(postings, spark.read.schema("term string, df bigint").parquet(f"{path}/vocabulary"), totals["n_docs"], totals["avg_length"])


def stored_index(docs: DataFrame, id_col: str, fields: Mapping[str, Column], folder: str, name: str) -> Index:
    """The index of ``docs`` under ``folder``, written if there is none yet for the files that ``docs`` reads as they are now."""
    spark = docs.sparkSession
    files = sorted(docs.inputFiles())
    hadoop = spark._jvm.org.apache.hadoop.fs
    state = [name]
    for f in files:
        at = hadoop.Path(f)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        state.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    path = f"{folder.rstrip('/')}/index-{hashlib.sha256(chr(10).join(state).encode()).hexdigest()[:32]}"
    kind = docs.schema[id_col].dataType.simpleString()
    try:
        return read_index(spark, path, kind)
    except AnalysisException:
        write_index(docs, id_col, fields, path)
        return read_index(spark, path, kind)


def resolve(index: Index, groups: Sequence[search.Group]) -> list[tuple[int, str, int, float]]:
    """(grp, term, df, weight) of the terms that answer a query, by one pass over the vocabulary for all groups.

    As ``search.resolved_terms``: the variants that the vocabulary has, the most frequent terms with a prefix, and the nearest ones by edit distance
    where a group found neither. Each group sends a bounded number of terms to the driver.
    """
    groups = search.checked(groups)
    term, df = F.col("term"), F.col("df")
    long = max((len(x.variants) for x in groups), default=0)
    found = []

    def row(g: int, place: int, when: Column, weight: Column, first: Column) -> Column:
        return F.when(when, F.struct(F.lit(g).alias("grp"), F.lit(place).alias("place"), weight.alias("weight"), first.cast("long").alias("first")))

    for g, x in enumerate(groups):
        word = x.variants[0][0]
        found += [row(g, i, term == v, F.lit(float(w)), F.lit(0)) for i, (v, w) in enumerate(x.variants)]
        if x.prefix:
            found.append(row(g, long, term.startswith(word), F.when(term == word, 1.0).otherwise(search.PREFIX_WEIGHT), F.lit(0)))
        if x.fuzzy:
            near, distance, weight = search.near(term, word)
            found.append(row(g, long + 1, near, weight, distance))
    if not found:
        return []
    hits = index.vocabulary.select("term", "df", F.explode(F.array_compact(F.array(*found))).alias("h")).select("term", "df", "h.*")
    most = F.when(F.col("place") == long, search.PREFIX_TERMS).when(F.col("place") == long + 1, search.FUZZY_TERMS).otherwise(1)
    place = F.row_number().over(Window.partitionBy("grp", "place").orderBy("first", F.desc("df"), "term"))
    rows = hits.withColumn("n", place).where((F.col("n") <= max(search.PREFIX_TERMS, search.FUZZY_TERMS)) & (F.col("n") <= most)).collect()
    literal = {r.grp for r in rows if r.place in (0, long)}
    out: dict[tuple[int, str], tuple[int, str, int, float]] = {}
    for r in sorted(rows, key=lambda r: r.place):
        if r.place <= long or r.grp not in literal:
            out.setdefault((r.grp, r.term), (r.grp, r.term, r.df, r.weight))
    return list(out.values())


def answer(index: Index, groups: Sequence[search.Group], codes: Sequence[str] = (), boosted: bool = True) -> DataFrame:
    """(doc, score) of a query: BM25 over the resolved terms, by field boost if ``boosted``, and CODE_BOOST for each code that a document has.

    Every group that weighs fully and found a term must hit, unless a code does; an empty query finds nothing. Of the postings only those of the
    query's terms are read, by a filter on the sorted column; one aggregation by document follows.
    """
    terms = resolve(index, groups)
    spark = index.postings.sparkSession
    full = {g for g, x in enumerate(groups) if x.variants[0][1] >= 1}
    need = 0
    for g, *_ in terms:
        need |= (1 << g) if g in full else 0
    rows = [*terms, *((-1, c, 1, 0.0) for c in dict.fromkeys(codes))]
    wanted = spark.createDataFrame(rows, "grp int, term string, df long, weight double")
    n, mean = float(index.n_docs), float(index.avg_length)
    one = search.idf(F.lit(n), F.col("df")) * F.col("weight") * search.tf_part(F.col("tf"), F.col("doc_length"), F.lit(mean))
    one = one * fielded.boost(F.col("mask")) if boosted else one
    code = F.col("grp") < 0
    mine = index.postings.where(F.col("term").isin(*sorted({r[1] for r in rows}))) if rows else index.postings.where(F.lit(False))
    hits = mine.join(F.broadcast(wanted), "term").select("doc", F.when(code, search.CODE_BOOST).otherwise(one).alias("score"), F.when(code, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, grp)")).alias("groups"))
    out = hits.groupBy("doc").agg(F.sum("score").alias("score"), F.bit_or("groups").alias("groups"))
    return out.where(F.col("groups").bitwiseAND(F.lit(need).cast("long")) == need).select("doc", "score")
