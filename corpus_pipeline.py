"""Training-data pipeline over `documents`: language ID, line dedup, near-duplicate documents, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import langid, lines, mixing, ngram_join, packing
from factweave.llm.common import free_name, row_key, table
from factweave.llm.queries import tokenizer
from factweave.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted language go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, but for one occurrence; documents of which nothing is left go too."""
    return lines.dedup_lines(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows that repeat its id and text are one.

    Only documents that go are looked up, by a key of doc_id and text. Documents without words are no copies of one another and all stay.
    """
    found = ngram_join.grouped(docs).withColumn("key", F.struct("r1", "r2"))
    row = free_name(docs, "_row")
    keyed = docs.select("*", F.struct(*row_key()).alias(row))
    gone = found.filter("not stays").select(F.col("key").alias(row)).distinct()
    left = keyed.join(gone, row, "left_anti")
    twice = found.filter("stays and copies > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias(row))
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, row, "left_anti")
    return once.select(*docs.columns).unionByName(left.join(twice, row, "left_semi").dropDuplicates([row]).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which may be never."""
    mixed = mixing.mix(docs).filter("repeats > 0")
    return mixed.withColumn(free_name(mixed, "_copy"), F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packing.pack(packing.tokenise(docs, tokenizer()))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash, MinHash and byte-pair merges are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
