"""A corpus pipeline over documents: five stages, each an operator of lexiflow.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. The first four
return the columns of documents; the last one returns how many words the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import decontaminate, lines, minhash, mixing, quality
from lexiflow.session import checkpoint, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one or nearly so; documents of which nothing is left go."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return minhash.one_of_each(docs, similarity=80, size=5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words taken of each document so that sources meet their target weights."""
    return mixing.mix(docs)


STAGES = [("quality classifier", good), ("line dedup", own_lines), ("MinHash near-dedup", one_of_each), ("benchmark decontamination", clean), ("mixing to target weights", mixed)]

#: Neither the trained classifier nor the seeded budget fit can be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
