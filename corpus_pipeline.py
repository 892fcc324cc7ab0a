"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing. Each stage but the
last returns the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import decontaminate, line_dedup, packing, quality, simhash
from strataflow.sources.checkpoints import remove, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes; it learns from the labels of two folds in three.

    Null and empty texts are judged as empty ones, equal rows alike; without labels all stay.
    """
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them share; the largest id keeps them. No row goes; null
    texts become empty, n_chars follows the text."""
    return line_dedup.without_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id; null ids count as the largest, and of
    empty texts, which are alike, one stays."""
    return simhash.one_of_each(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, and all where there are no items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens; a null or empty text is one token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_items),
    ("packing", pack),
]

#: The first stage learns a model, which SQL cannot express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps lies as Parquet in the shared checkpoint folder.

    A stage's folder goes when the next one is written; the last one's input stays, as the result reads it. Each
    stage says in its operator what it does with nulls, empty and very long texts, ties, equal rows and an empty
    table; an empty table stays one through all stages.
    """
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
