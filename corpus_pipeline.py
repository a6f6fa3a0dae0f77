"""The corpus pipeline: five stages over ``documents``; each reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import stages

STAGES = stages.STAGES
#: The stages train models and build indexes, which SQL cannot express; tests/llm checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their cleaned text and columns, and tokens, posteriors and rate.

    Each stage's result is written to the shared folder and reread.  Null, empty and repeated rows, empty
    tables and extra columns are as the stages (``llm/stages.py``) define them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stages.written(docs, name)
    return docs
