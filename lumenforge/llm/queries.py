"""One query for each training-data operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import chat, embedding_dedup, exact_dedup, html_text, language_model, license_scan, packing, periodic_runs, piece_encoding, quality, simhash, toxicity, vector_codes
from lumenforge.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; it is read, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_embeddings(read_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), added=packing.added_tokens(tokenizer_path("byte_bpe_50k.json")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(read_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.piece_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(read_table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(read_table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.col("places.label"))
    found = F.array_distinct(F.concat(base, F.col("spans.label")))
    return scanned.select(
        F.col("_0").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(found), ",").alias("labels"),
        "score",
    )


def _made_periodic(docs: DataFrame) -> DataFrame:
    """One text in ten, by its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(ws):  # bound once, so that the text is split once
        n = F.size(ws)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int"))))

    rewritten = F.array_join(F.element_at(F.transform(F.array(words), repeated), 1), " ")
    return docs.select("doc_id", F.when(h % 10 == 0, F.when(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), rewritten)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_made_periodic(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(F.col("_0").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_exact_dedup,
        op3_embedding_dedup,
        op4_packing,
        op5_toxicity,
        op6_html_extraction,
        op7_sentencepiece,
        op8_lm_scoring,
        op9_quality,
        op10_simhash,
        op11_vector_codes,
        op12_license_scan,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
}
