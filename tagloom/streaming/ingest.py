"""Back-translation tables: requests (T15), response split (T16), lineage join (J04) and
the incremental response ingest (S08) as Structured Streaming jobs: once per file
(``ingest_responses``), or once per request (``ingest_answers``), after which ``open_requests``
are those still to be asked.

The remote call itself is not built.  Responses over the driver tables are
``lang + '#####' + text`` of each document, with malformed answers for every tenth
document (no separator) and every twentieth from the tenth (three parts).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import RESPONSE_ERR, RESPONSE_SEP
from tagloom.session import scratch_path

SYSTEM_PROMPT = ("Translate the review to English, then translate that back to colloquial Chinese. "
                 "Answer as: English part#####Chinese part")


def request_table(sample: DataFrame, repeat: int = 1, key: str = "id", text: str = "text") -> DataFrame:
    """One request row per sampled review and repetition."""
    return sample.select(F.col(key).alias("oid"), F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("rep"),
                         F.lit(SYSTEM_PROMPT).alias("system"), F.col(text).alias("user"))


def responses_from_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """Stand-in answers (oid, .., content) built from the documents table."""
    content = (F.when(F.pmod("doc_id", F.lit(20)) == 10,
                      F.concat_ws(RESPONSE_SEP, "lang", "source", "text"))
               .when(F.pmod("doc_id", F.lit(10)) == 0, F.col("text"))
               .otherwise(F.concat_ws(RESPONSE_SEP, "lang", "text")))
    return docs.select(F.col("doc_id").alias("oid"), *keep, content.alias("content"))


def split_response(df: DataFrame, content: str = "content", keep: tuple | list = ("oid",)) -> DataFrame:
    """Exactly two parts -> (en, cn); otherwise en = the parts as a JSON array, cn = 'ERR'."""
    parts = F.split(F.col(content), RESPONSE_SEP, -1)
    listed = F.to_json(parts)
    ok = F.size(parts) == 2
    return df.select(*keep, F.when(ok, F.element_at(parts, 1)).otherwise(listed).alias("en"),
                     F.when(ok, F.element_at(parts, 2)).otherwise(F.lit(RESPONSE_ERR)).alias("cn"))


def backtranslation_join(retrans: DataFrame, train: DataFrame) -> DataFrame:
    """A back-translated row inherits the class of its source review (oid -> id)."""
    good = retrans.filter(F.col("cn") != RESPONSE_ERR)
    return good.join(train.select(F.col("id").alias("oid"), "class"), "oid", "inner") \
        .select("oid", F.col("cn").alias("text"), "class")


def ingest_responses(spark: SparkSession, sf_dir: str, sink: str | None = None) -> str:
    """Stream the answer table into an append-only Parquet sink, exactly once.

    The file source tracks which input files were consumed in the checkpoint, so a rerun
    on the same ``sink`` adds nothing (the reference rewrote the whole table per answer).
    Sink and checkpoint live under the shared checkpoint folder.
    """
    sink = sink or scratch_path(spark, "retrans")
    out = split_response(responses_from_documents(arriving(spark, sf_dir, "documents")))
    q = (out.writeStream.format("parquet").option("path", os.path.join(sink, "data"))
         .option("checkpointLocation", os.path.join(sink, "_checkpoint"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return os.path.join(sink, "data")


# ----------------------------------------------------------------------------------
# S08 by key: one answer for each request, whatever arrives twice or late
# ----------------------------------------------------------------------------------
KEY = ["oid", "rep"]
ANSWER = "oid long, rep int, en string, cn string"


def arriving(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a table as a stream; the table is one file or a folder of files.

    The last letter is given as a pattern, as a stream takes a single file only by a pattern.
    """
    path = os.path.join(sf_dir, f"{table}.parquet")
    return (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(os.path.join(sf_dir, f"{table}.parque[t]")))


def answers_from_documents(docs: DataFrame) -> DataFrame:
    """Stand-in answers (oid, rep, content): every document's first request, every third's second as well,
    and every seventh's first once more."""
    reps = F.concat(F.array(F.lit(1)), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")),
                    F.when(F.pmod("doc_id", F.lit(7)) == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return responses_from_documents(docs.select("*", F.explode(reps).alias("rep")), "rep")


def first_answers(answers: DataFrame) -> DataFrame:
    """One answer for each key of a batch: the least content, null last, whatever their order."""
    content = F.min(F.struct(F.col("content").isNull().alias("none"), "content"))["content"]
    return answers.groupBy(*KEY).agg(content.alias("content"))


def ingest_answers(stream: DataFrame, sink: str | None = None) -> str:
    """S08 by key: stream answers (oid, rep, content) into a table with one row for each request.

    A micro-batch's answers are made one per key, those whose key an earlier batch has are left out by
    an anti-join, and the rest is written to the batch's own folder, which a repeated batch replaces.
    The table's keys are the state: nothing is held in memory between batches.  Returns the folder of
    (oid, rep, en, cn, batch).
    """
    from tagloom.streaming.score import batch_folder, run_batches

    spark = stream.sparkSession
    sink = sink or scratch_path(spark, "answers")
    data = os.path.join(sink, "data")

    def write(batch: DataFrame, number: int) -> None:
        new = split_response(first_answers(batch), keep=KEY)
        if number > 0:
            known = spark.read.schema(ANSWER + ", batch long").parquet(data).where(F.col("batch") < number).select(*KEY)
            new = new.join(known, [new[k].eqNullSafe(known[k]) for k in KEY], "left_anti")
        new.select("oid", F.col("rep").cast("int").alias("rep"), "en", "cn").write.mode("overwrite").parquet(batch_folder(sink, number))

    run_batches(stream, sink, write)
    return data


def open_requests(requests: DataFrame, answers: DataFrame, ask_again: bool = False) -> DataFrame:
    """The requests that no answer in the table settles; ``ask_again``: malformed answers settle none."""
    settled = answers.where(F.col("cn") != RESPONSE_ERR) if ask_again else answers
    return requests.join(settled.select(*KEY).distinct(), KEY, "left_anti")
