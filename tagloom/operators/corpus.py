"""Corpus assembly: sources, harmonisation, provenance, strict class, unions (S03-S05,
P04-P07, P10-P11, U01-U03, G04).

Auxiliary sources over the driver tables (SURVEY 7.1): generated rows = assistant turns of
``conversations``; external reviews = ``documents`` of one ``source`` (the category);
back-translations = ``benchmark``.  Rows without a class take ``key % 3``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import bio
from tagloom.sources import driver

EXT_CATEGORY = "src0"

MOOD_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                            T.StructField("class", T.IntegerType())])


def schema_seed(spark: SparkSession) -> DataFrame:
    """Zero rows with the training columns minus ``BIO_anno`` (a union seed)."""
    return spark.createDataFrame([], MOOD_SCHEMA)


def gpt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows (text, class); they carry no id."""
    c = driver.table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role") == "assistant")
            .select("text", F.pmod(F.col("conv_id"), F.lit(3)).cast("int").alias("class")))


def ext_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External review table as it is read: (cat, label, review)."""
    d = driver.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("cat"), F.pmod(F.col("doc_id"), F.lit(3)).cast("int").alias("label"),
                    F.col("text").alias("review"))


def filter_category(ext: DataFrame, category: str = EXT_CATEGORY) -> DataFrame:
    """Keep one category (first column); pushed down to the parquet scan."""
    return ext.filter(F.col("cat") == F.lit(category))


def harmonise_ext(ext: DataFrame) -> DataFrame:
    """Rename to the common columns and project."""
    return ext.withColumnRenamed("review", "text").withColumnRenamed("label", "class").select("text", "class")


def trans_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-translated rows (oid, text); the English side is dropped."""
    b = driver.table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("oid"), F.col("text").alias("cn"),
                    F.pmod(F.col("item_id"), F.lit(3)).cast("int").alias("class")) \
        .withColumnRenamed("cn", "text")


def origin_rows(spark: SparkSession, sf_dir: str, mark: bool = False) -> DataFrame:
    r = driver.reviews(spark, sf_dir)
    text = bio.mark_text(F.col("text"), bio.bio_split("BIO_anno")) if mark else F.col("text")
    return r.select("id", text.alias("text"), "class")


def mood_corpus(spark: SparkSession, sf_dir: str, with_origin: bool = True, with_gpt: bool = False,
                mark: bool = False, from_retrans: bool = False, with_ext: bool = False) -> DataFrame:
    """Mixed mood corpus with provenance ``type`` (P06) and a strict class.

    Missing columns become null (U01, ``unionByName(allowMissingColumns=True)``).
    """
    parts = [(origin_rows(spark, sf_dir, mark) if with_origin else schema_seed(spark))
             .withColumn("type", F.lit("origin"))]
    if with_gpt:
        parts.append(gpt_rows(spark, sf_dir).withColumn("type", F.lit("gpt")))
    if with_ext:
        parts.append(harmonise_ext(filter_category(ext_raw(spark, sf_dir))).withColumn("type", F.lit("ext")))
    if from_retrans:
        parts.append(trans_rows(spark, sf_dir).withColumn("type", F.lit("trans")))
    data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return strict_class(data)


def strict_class(df: DataFrame) -> DataFrame:
    """Class must be a non-null integer; a null fails the job."""
    return df.withColumn("class", F.when(F.col("class").isNotNull(), F.col("class").cast("int"))
                         .otherwise(F.raise_error(F.lit("class is null")).cast("int")))


def null_rows(df: DataFrame) -> DataFrame:
    """P10: rows with a null in any column."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns]))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Reject an empty dataset (one cheap action: ``isEmpty`` reads one row)."""
    if df.isEmpty():
        raise ValueError(f"no data found in {what}")
    return df
