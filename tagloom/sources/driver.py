"""Annotated-review tables derived from the driver's parquet tables.

The driver data has no BIO column, so one is derived deterministically (the same rule
is written independently in DuckDB for the oracle):

1. ``text`` = the whole ``documents.text``, ``id`` = ``doc_id``;
2. the text is cut into maximal ASCII-letter runs and the runs between them;
3. a letter run whose lower-cased word is in ``CORPUS_LEXICON`` gets ``B-kind`` on its
   first character and ``I-kind`` on the rest, and so do two runs with one blank between them
   whose words are in ``CORPUS_PAIRS`` (as one mention); every other character gets ``O``;
4. ``class`` from ``labels``: toxic -> 0 (NEG), else quality -> 1 (POS), else 2 (NEU).

Labelled documents are the training corpus, unlabelled ones the test set.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import CORPUS_LEXICON, CORPUS_PAIRS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def mention_pattern() -> str:
    """The lexicon's mentions as whole letter runs, pairs first.

    One pass from the left gives the rule's mentions as long as no pair ends with a word that another
    begins with, so that no run is in two pairs.
    """
    if {b for _, b in CORPUS_PAIRS} & {a for a, _ in CORPUS_PAIRS}:
        raise ValueError("pairs of the corpus lexicon overlap")
    mentions = [f"{a} {b}" for a, b in CORPUS_PAIRS] + list(CORPUS_LEXICON)
    first = "".join(sorted({m[0].lower() for m in mentions}))        # most places are none by their character alone
    return rf"(?i)(?=[{first}])(?<![A-Za-z])(?:" + "|".join(mentions) + r")(?![A-Za-z])"


def lexicon_tag(text) -> "F.Column":
    """BIO string of a text under the fixed corpus lexicon (row-local, no explode).

    Only the mentions are looked at one by one; what lies between them is ``O`` by its length.
    """
    kinds = {f"{a} {b}": v for (a, b), v in CORPUS_PAIRS.items()} | CORPUS_LEXICON
    kind_of = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    pattern = mention_pattern()

    def labels(between, mention):
        kind = F.element_at(kind_of, F.lower(mention))
        outside = F.repeat(F.lit("O "), F.length(between))
        return F.when(mention.isNull(), outside).otherwise(F.concat(
            outside, F.lit("B-"), kind, F.repeat(F.concat(F.lit(" I-"), kind), F.length(mention) - 1), F.lit(" ")))

    return F.rtrim(F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), labels), ""))


def mood_class(labels: DataFrame) -> DataFrame:
    return labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2)
        .cast("int").alias("class"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, source): the review text the corpus is made of."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text"),
        F.col("source"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated training reviews (id, text, BIO_anno, class) plus ``source``."""
    docs = documents(spark, sf_dir)
    cls = mood_class(table(spark, sf_dir, "labels"))
    return (docs.join(cls, "id", "inner")
            .select("id", "text", lexicon_tag(F.col("text")).alias("BIO_anno"), "class", "source"))


def test_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled reviews (id, text): the test set."""
    docs = documents(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(lab, "id", "left_anti").select("id", "text")
