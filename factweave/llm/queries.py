"""The registered query of each operator of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import ann, centroids, chat, hard_negatives, langid, lines, mixing, ngram_join, packing, substrings, syncmers, toxicity, warc
from factweave.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(table(spark, sf_dir, "documents"), tokenizer()))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                          F.col("warc_type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_lines(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and per page; the other id is null. Both train the models."""
    none = F.lit(None).cast("long")
    docs = langid.document_rows(table(spark, sf_dir, "documents"), F.col("doc_id"), none.alias("page_id"))
    pages = langid.page_rows(table(spark, sf_dir, "pages"), none.alias("doc_id"), F.col("page_id"))
    rows = docs.unionByName(pages)
    languages, logs = langid.train(rows.select("text", "declared"))
    return langid.identify(rows, languages, logs)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edits(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_warc, op3_adaptive_scan, op4_toxicity, op5_source_mixing, op6_line_dedup, op7_chat_formatting, op8_language_id,
    op9_ngram_jaccard, op10_syncmer_fingerprints, op11_substring_dedup, op12_hard_negatives, op13_centroid_clustering)}
SQL: dict[str, str] = {"op7_chat_formatting": chat.SQL, "op11_substring_dedup": substrings.SQL, "op12_hard_negatives": hard_negatives.SQL,
                       "op13_centroid_clustering": centroids.SQL}
