"""From raw documents to packed sequences: language, near duplicates, benchmark passages, packing.

Each stage works on all rows that the one before kept and returns the columns of documents; the last returns the pieces of the
sequences. `run` writes what each stage returns and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm import decontaminate, langid, minhash, packing
from cohortloom.llm.common import ship, table, written
from cohortloom.llm.queries import TOKENIZER, learned_profiles

#: Texts in a learned language reach 0.4 and more; this only turns away what resembles none of them.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a recognisable language."""
    ship(spark)
    return langid.keep_identified(docs, learned_profiles(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id, and of equal rows one; rows with a null id all stay."""
    ship(spark)
    gone = minhash.near_duplicates(docs, written).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    return left.withColumn("_again", F.when(F.col("doc_id").isNull(), 1).otherwise(again)).filter("_again = 1").drop("_again")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    ship(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), written)
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 tokens."""
    ship(spark)
    return packing.packed_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packing", packed),
]

#: Language profiles, MinHash groups, slot checks and packing have no SQL form; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
