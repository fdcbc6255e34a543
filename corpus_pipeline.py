"""A corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes the rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from fieldweave.llm.common import delete, shared_folder, table, workspace

#: No SQL gives language profiles, MinHash joins and packing; the stages are tested against plain Python.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that labelled documents have; those without a letter, or unlike all that was learned, go."""
    return language_id.keep_known(docs, docs.where(~language_id.held_out()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes."""
    return quality_rules.keep_passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and similar texts."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("languages", languages),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents; every stage's rows are written and read again. Only the last stage's rows are left in the shared folder."""
    docs, folder, read = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            delete(spark, read)  # all that follows reads this stage's rows
        docs, read = spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}"
    return docs
