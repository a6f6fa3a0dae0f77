"""Batch metrics, epoch roll-ups, keep-best decisions and the epoch log (A01-A04, A06,
J03, W01-W02, S09).

Driver stand-in for training logs: ``events`` rows are batch items.  ``run`` =
``(user_id div 10) % 20``; ``epoch`` = ``event_id div 500`` (0-based); ``batch`` = ``event_id % 20``;
an item is in validation when ``user_id % 10 = 0``; its loss is ``value`` and it is a hit
when ``value < 50``.  A batch holding an ``error`` event worth more than 450 failed: its
loss is null but it still counts in the loss denominator (A04).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.session import materialize
from tagloom.sources import driver

# the reference's epoch record, multi-line; val_Accuracy is absent when there is no validation
EPOCH_RE = (r"Epochs: (\d+) \|\s+Loss:\s+(\S+) \|\s+Accuracy:\s+(\S+) \|"
            r"(?:\s+val_Accuracy:\s+(\S+) \|)?")


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = driver.table(spark, sf_dir, "events")
    return e.select(
        F.pmod(F.floor(F.col("user_id") / 10), F.lit(20)).alias("run"),
        (F.col("event_id") / 500).cast("long").alias("epoch0"),
        F.pmod("event_id", F.lit(20)).alias("batch"),
        F.when(F.pmod("user_id", F.lit(10)) == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.col("value").alias("loss"),
        F.when(F.col("value") < 50, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit"),
        ((F.col("event_type") == "error") & (F.col("value") > 450)).alias("failed"))


def batch_metrics(items: DataFrame) -> DataFrame:
    """A01/A02 shape: per-batch mean accuracy and loss (failed batch -> null loss)."""
    return items.groupBy("run", "epoch0", "split", "batch").agg(
        F.when(F.max(F.col("failed").cast("int")) == 1, F.lit(None).cast("double"))
        .otherwise(F.avg("loss")).alias("loss"),
        F.avg("hit").alias("acc"))


def epoch_rollup(batches: DataFrame) -> DataFrame:
    """Unweighted mean of batch means; failed batches count in the loss denominator."""
    tr = batches.filter(F.col("split") == "train").groupBy("run", "epoch0").agg(
        (F.sum(F.coalesce("loss", F.lit(0.0))) / F.count(F.lit(1))).alias("loss"),
        F.avg("acc").alias("acc"))
    va = batches.filter(F.col("split") == "val").groupBy("run", "epoch0").agg(F.avg("acc").alias("val_acc"))
    return (tr.join(va, ["run", "epoch0"], "left")
            .select("run", (F.col("epoch0") + 1).alias("epoch"), "loss", "acc", "val_acc"))


RANGE = 4096            # epochs whose running best one task finds


def best_epochs(epochs: DataFrame, freq: int = 5, run: str = "run", size: int = RANGE) -> DataFrame:
    """Strict improvement on the running best (start -1); saved = best, else the
    0-based epoch is a multiple of ``freq``; ``freq = 0`` disables saving.

    The running maximum has two levels: the maxima of ranges of ``size`` epochs, few enough for one
    window over a run's ranges, and the window inside each range, which starts with what the ranges
    before it reached.  So a long run is spread over as many tasks as it has ranges.
    """
    if not freq:
        return epochs.withColumn("is_best", F.lit(False)).withColumn("saved", F.lit(False))
    cut = epochs.withColumn("__range", F.floor(F.col("epoch") / size))
    before = Window.partitionBy(run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (cut.groupBy(run, "__range").agg(F.max("val_acc").alias("__max"))
               .select(F.col(run).alias("__run"), F.col("__range").alias("__r"), F.max("__max").over(before).alias("__carry")))
    inside = Window.partitionBy(run, "__range").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.join(carried, cut[run].eqNullSafe(carried["__run"]) & cut["__range"].eqNullSafe(carried["__r"]))
    best = F.coalesce(F.greatest(F.max("val_acc").over(inside), F.col("__carry")), F.lit(-1.0))
    periodic = F.pmod(F.col("epoch") - 1, F.lit(freq)) == 0
    return (rows.withColumn("is_best", F.coalesce(F.col("val_acc") > best, F.lit(False)))
            .withColumn("saved", F.col("is_best") | periodic).select(*epochs.columns, "is_best", "saved"))


def render_epoch_log(epochs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The log record of each epoch, as the training loop writes it (one text per epoch)."""
    fmt = lambda c: F.format_string(" %.8f", F.col(c))
    body = F.concat(F.lit("Epochs: "), F.col("epoch").cast("string"), F.lit(" | \n                Loss: "),
                    fmt("loss"), F.lit(" | \n                Accuracy: "), fmt("acc"), F.lit(" |"))
    val = F.when(F.col("val_acc").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("\n                val_Accuracy: "), fmt("val_acc"), F.lit(" |")))
    return epochs.select("run", *(keep or []), F.concat(body, val, F.lit("\n")).alias("record"))


def parse_epoch_records(df: DataFrame, text: str = "record", keep: list[str] | None = None) -> DataFrame:
    """Epoch records in a text column -> (epoch, loss, acc, val_acc); ``nan`` -> NaN.

    Works on whole log files too (``read_epoch_log``): every record in the text is
    extracted with ``regexp_extract_all`` and zipped back into rows.
    """
    keep = keep or []
    groups = [F.regexp_extract_all(F.col(text), F.lit(EPOCH_RE), i) for i in range(1, 5)]
    z = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ["e", "l", "a", "v"])])
    rows = df.select(*keep, F.explode_outer(z).alias("r")).filter(F.col("r").isNotNull())
    num = lambda c: F.when(F.lower(c) == "nan", F.lit(float("nan"))).otherwise(c.cast("double"))
    return rows.select(*keep, F.col("r.e").cast("int").alias("epoch"), num(F.col("r.l")).alias("loss"),
                       num(F.col("r.a")).alias("acc"),
                       num(F.nullif(F.col("r.v"), F.lit(""))).alias("val_acc"))


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """S09 reader: epoch rows of log files, one record per input row.

    A file is cut at ``Epochs: `` while it is read, so a long log is split over tasks.
    """
    raw = spark.read.text(path, lineSep="Epochs: ").select(F.concat(F.lit("Epochs: "), F.col("value")).alias("value"),
                                                           F.input_file_name().alias("file"))
    return parse_epoch_records(raw, "value", ["file"])


BATCH_LINE = r"val acc (\S+)"


def read_ordered_log(spark: SparkSession, path: str) -> DataFrame:
    """S09 with batch lines: (file, number, epoch, loss, acc, val_acc, batch_acc) of the log files in ``path``.

    ``number`` counts a file's epoch records from 1 in the file's order; ``batch_acc`` are the values of the
    ``val acc`` lines since the record before, in order.  Lines after a file's last record belong to an epoch
    that was not finished: a row whose epoch is null, if there are any.  ``Epochs: `` must not occur but in
    records.  A file is read in as many splits as
    it has; a record's place is its split's start and its place in the split.  What crosses from one split to
    the next is one row a split: its number of records and the values that its last record leaves open.
    """
    raw = spark.read.text(path, lineSep="Epochs: ").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.concat(F.lit("Epochs: "), F.col("value")).alias("record"))
    values = F.regexp_extract_all("record", F.lit(BATCH_LINE), 1).cast("array<double>")
    rows = materialize(raw.select("file", "start", "at", values.alias("after"), *[
        F.regexp_extract("record", "^" + EPOCH_RE, i).alias(c) for i, c in enumerate(["e", "l", "a", "v"], 1)]), "log_records")
    found = F.when(F.col("e") != "", 1).otherwise(0)        # the text before the first record of a file is no record
    splits = rows.groupBy("file", "start").agg(F.max_by("after", "at").alias("open"), F.sum(found).alias("n"))
    before = Window.partitionBy("file").orderBy("start")
    carried = splits.select("file", "start", F.lag("open").over(before).alias("__open"),
                            F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))
    inside = Window.partitionBy("file", "start").orderBy("at")
    nothing = F.array().cast("array<double>")
    num = lambda c: F.when(F.lower(c) == "nan", F.lit(float("nan"))).otherwise(F.nullif(c, F.lit("")).cast("double"))
    numbered = rows.join(carried, ["file", "start"]).select(
        "file", (F.col("__n") + F.sum(found).over(inside)).alias("number"), F.nullif("e", F.lit("")).cast("int").alias("epoch"),
        num(F.col("l")).alias("loss"), num(F.col("a")).alias("acc"), num(F.col("v")).alias("val_acc"),
        F.coalesce(F.lag("after").over(inside), F.when(F.row_number().over(inside) == 1, F.col("__open")), nothing).alias("batch_acc"))
    ends = rows.groupBy("file").agg(F.max_by("after", F.struct("start", "at")).alias("batch_acc"), F.sum(found).alias("n"))
    none = F.lit(None).cast("double")
    unfinished = ends.where(F.size("batch_acc") > 0).select("file", (F.col("n") + 1).alias("number"), F.lit(None).cast("int").alias("epoch"),
                                                            none.alias("loss"), none.alias("acc"), none.alias("val_acc"), "batch_acc")
    return numbered.where(F.col("epoch").isNotNull()).unionByName(unfinished)


def write_log(batches: DataFrame, path: str) -> None:
    """One log file for each run, as the training loop writes it: an epoch's validation batches, then its record."""
    lines = batches.where("split = 'val'").groupBy("run", (F.col("epoch0") + 1).alias("epoch")).agg(
        F.array_sort(F.collect_list(F.struct("batch", "acc"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat(F.lit("val acc "), x["acc"].cast("string"), F.lit("\n"))), "")
    records = render_epoch_log(epoch_rollup(batches), keep=["epoch"]).join(lines, ["run", "epoch"], "left")
    (records.select("run", "epoch", F.concat(F.coalesce(text, F.lit("")), "record").alias("value"))
     .repartition("run").sortWithinPartitions("run", "epoch").select("run", "value")
     .write.mode("overwrite").partitionBy("run").text(path))


def argmax(arr) -> "F.Column":
    """Index of the first maximum (0-based)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
