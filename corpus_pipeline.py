"""The corpus pipeline: stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents: language ID drops documents without a letter, the n-gram join keeps one document of each group
of near duplicates (five words, similarity 0.8), decontamination drops documents with copies of test items, secret
scans put a mark in place of secrets, and packing returns the pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameflow.llm.common import discard, scratch, stored
from frameflow.llm.decontam import clean
from frameflow.llm.jaccard import one_of_each
from frameflow.llm.langid import accepted
from frameflow.llm.packing import pack
from frameflow.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("packing", packing),
]

#: Tokenizer ids and learnt models are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result a table in the shared folder that goes once the next one is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:  # a stage's own tables go once its result is written
            docs = stored(stage(spark, docs, sf_dir), name)
            made.keep(docs)
        if held is not None:
            discard(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
