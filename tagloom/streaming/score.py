"""Scoring texts as they arrive: every micro-batch is joined with the fitted tables and written once.

The batch's folder is named by its number and overwritten, so a batch that is repeated after a
failure replaces what it wrote before: with the checkpoint, which knows the files of each batch,
every arriving row is in the sink exactly once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame

from tagloom.operators import scoring
from tagloom.session import remove_at_exit, scratch_path


def run_batches(stream: DataFrame, sink: str, write: Callable[[DataFrame, int], None]) -> None:
    """All that has arrived, batch by batch, from where the checkpoint in ``sink`` ends."""
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(sink, "_checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def batch_folder(sink: str, number: int) -> str:
    return os.path.join(sink, "data", f"batch={number}")


def score_stream(stream: DataFrame, models: scoring.Models, sink: str | None = None,
                 prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> str:
    """Score a stream of (id, text); returns the folder of the scored table (id, BIO_anno, class, batch).

    ``prepare`` turns a micro-batch into rows (id, text), for example by a join with static tables.  Call
    again with the same ``sink`` for what has arrived since, or to finish a run that was ended.
    """
    if sink is None:
        sink = scratch_path(stream.sparkSession, "scored")
        remove_at_exit(stream.sparkSession, sink)

    def write(batch: DataFrame, number: int) -> None:
        scoring.score(prepare(batch), models).write.mode("overwrite").parquet(batch_folder(sink, number))

    run_batches(stream, sink, write)
    return os.path.join(sink, "data")
