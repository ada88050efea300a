"""A corpus-cleaning pipeline: quality, toxicity, exact and near duplicates, then packing.

Each stage takes (spark, docs, sf_dir), works on every row it gets and returns a DataFrame;
the runner writes it as Parquet and reads it back as the next stage's ``docs``. All but the last return the columns of ``documents``.
The classifiers carry rows along with their scores, so that no text is shuffled for a verdict.

Null and empty texts are judged as empty texts, null ids pass the classifiers and the duplicate stages like other ids. Rows with one doc_id are judged each by
its own text; rows that repeat both are one document, of which one row stays. Empty tables and further columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import exact_dedup, packing, quality, simhash, toxicity
from lumenforge.llm.common import ascii_lower, discard_paths, materialise, read_table, written
from lumenforge.llm.queries import tokenizer_path


#: Scratch tables of the stage before, which are no longer read once its result is written.
_left: set[str] = set()


def _stage(f):
    """A stage that first deletes what the stage before has left in the shared folder."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _left
        discard_paths(spark, _left)
        before = written()
        out = f(spark, docs, sf_dir)
        _left = written() - before
        return out

    return run_stage


def _few(rows: DataFrame, label: str, before: set[str]) -> DataFrame:
    """Write a verdict's few columns and delete the scratch tables, with texts, that led to it."""
    out = materialise(rows, label)
    discard_paths(rows.sparkSession, written() - before - {out._scratch})
    return out


def _scored(scored: DataFrame, docs: DataFrame, condition: str) -> DataFrame:
    """The rows of ``docs`` whose score meets ``condition``."""
    return scored.where(condition).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


@_stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return _scored(quality.scored_rows(docs, read_table(spark, sf_dir, "labels")), docs, "score >= 0.5")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not call toxic."""
    return _scored(toxicity.scored_rows(docs, read_table(spark, sf_dir, "labels")), docs, f"score < {toxicity.THRESHOLD}")


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that repeat it whole, one."""
    def key(i):
        return F.xxhash64(i, i.isNull())

    before = written()
    kept = exact_dedup.exact_dedup(docs).where("kept").select(key(F.col("doc_id")).alias("_id"), F.unhex("text_sha256").alias("_sha")).distinct()
    kept = _few(kept, "pipeline-kept", before)
    mine = docs.withColumns({"_id": key(docs.doc_id), "_sha": F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))})
    # rows that repeat both lie together after the join and need no further exchange
    return mine.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).drop("_id", "_sha")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, the one with the smallest doc_id."""
    before = written()
    kept = simhash.simhash_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_k")).distinct()
    kept = _few(kept, "pipeline-kept", before)
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._k), "left_semi")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences for training."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), added=packing.added_tokens(tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifiers and the packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage-" + name.lower().replace(" ", "-"))
    return docs
