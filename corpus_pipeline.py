"""Corpus pipeline: ``documents`` through five operators, each stage written as Parquet and read again by the next.

All stages but the last return the columns of documents; the last returns the
packing of what is left, a row per piece.

In every stage an empty table gives an empty table, texts are read whole whatever
their length, and extra columns of ``documents`` stay up to the last stage. What each stage
does with nulls and repeated rows is stated with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towerfill.llm import decontam, joinsim, packing, pii, quality
from towerfill.llm.common import words
from towerfill.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or come from a rejected host, go.

    A null or blank text fails; a null source is a host of its own; rows that repeat stay and count as often.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows that repeat an id and a text stay once. Texts without words are linked with nothing, so they stay; a
    null id is larger than any other, and a group of null ids alone stays whole.
    """
    return joinsim.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Documents and items without words, or null, have no window and hit nothing; rows that repeat share their fate.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text.

    Every row stays, repeated ones too; a null text stays null, and so does its ``n_chars``.
    """
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces (by words) in bins of the permitted lengths.

    A text without words, or null, is one row of length 0 without a bin; rows that repeat are packed as often.
    """
    return packing.pack(docs, F.size(words(F.col("text"))))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The conditional random field's spans can't be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
