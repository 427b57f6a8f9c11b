"""Corpus pipeline: quality rules, near-duplicate removal, repeated-string removal, packing.

Every stage reads what its predecessor kept, as a written table; its decisions change the rows for good. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import ngram_join, packing, quality, repeats
from pitspark.llm.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by sets of five words with a Jaccard likeness of 0.8 or more."""
    return ngram_join.representatives(docs, size=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words and strings of 400 bytes that occur twice are cut out of all texts; n_chars follows."""
    return repeats.remove(docs, words=51).withColumn("n_chars", F.char_length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 1024."""
    return packing.packed_documents(docs, capacity=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", sequences),
]

ORACLE_SQL = None  # compression, byte strings and BPE are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, "stage")
    return docs
