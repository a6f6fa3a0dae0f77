"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from tagloom.llm.queries import TARGETS, domains
from tagloom.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and very short texts go, repeated rows are judged each."""
    judged, v = quality_rules.judge(docs, C.table(spark, sf_dir, "labels"))
    return judged.where(F.col(f"{v}.kept")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates that an earlier document has.

    Rows that share an id are one document, rows with a null id stay as they are; a text may become empty.
    """
    out = line_dedup.dedup(docs, min_tokens=1)
    kinds = dict(out.dtypes)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; of its repeated rows one, and rows with a null id stay."""
    return simhash.keep_first(docs, shingle=4, distance=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without their removal spans; null and empty texts have none."""
    return decontaminate.clean(docs, C.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its text as the stages before left it, plus its tokens, domain posteriors and rate.

    Null and empty texts have rate 1; repeated rows and null ids are rows like others; an empty table
    gives none.  Where the documents have columns of those names the new ones end in an underscore.
    """
    return mixing.mix(docs, domains(C.table(spark, sf_dir, "labels")), TARGETS)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("mixing", mixture)]


def written(docs: DataFrame, name: str) -> DataFrame:
    return materialize(docs, f"pipeline-{name}")
