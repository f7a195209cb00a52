"""The text pipeline: language, quality, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  ``run``
writes each stage's rows to the shared folder and reads them again, so a lost executor repeats one stage's tasks at most.
Defined cases are those of the operators: an empty table gives no rows, null texts are rejected as undetermined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourceloom.llm import langid, packing, quality, similar
from sourceloom.llm.workdir import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined."""
    return langid.keep(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that no rule of policy v1 rejects."""
    return quality.keep(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return similar.dedup(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents left."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", best_fit_packing)]

ORACLE_SQL = None  # languages, fingerprints and token ids have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name, "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
