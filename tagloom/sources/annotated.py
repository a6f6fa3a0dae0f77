"""Annotated reviews as CSV files (S01, S02): what is wrong with a record is told, and nothing is dropped.

A file has a header and the columns (id, text, BIO_anno, class), or (id, text) for a test set.  Values
may be quoted, with doubled quotes and line breaks inside.  The columns of a record are checked against
the schema, the labels against the text; the first fault is in ``problem``:

* ``malformed``: too many or too few values, or one that is not of its column's type;
* ``no id``, ``no text``, ``no labels``, ``no class``: the value is missing (an empty one is missing);
* ``class``: not 0, 1 or 2;
* ``label count``: not one label for each character of the text;
* ``unknown label``: a name that is no entity label.

Repeated records and ids are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import ENTITY_LABELS
from tagloom.functions import bio
from tagloom.session import materialize

TEXTS = "id long, text string"
REVIEWS = TEXTS + ", BIO_anno string, class int"
RECORD = "record"                    # the text of a malformed record
FORMAT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def fault(labelled: bool = True) -> Column:
    """The first fault of a record, null if it has none."""
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    checks = [("malformed", F.col(RECORD).isNotNull()), ("no id", missing("id")), ("no text", missing("text"))]
    if labelled:
        names = bio.bio_split("BIO_anno")
        checks += [("no labels", missing("BIO_anno")), ("no class", missing("class")), ("class", ~F.col("class").isin(0, 1, 2)),
                   ("label count", F.size(names) != F.length("text")),
                   ("unknown label", F.size(F.array_except(names, F.array(*[F.lit(n) for n in ENTITY_LABELS]))) > 0)]
    return F.coalesce(*[F.when(wrong, F.lit(name)) for name, wrong in checks])


def read(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """All records of the CSV files in ``path``: the columns, ``record`` and ``problem``.

    Every column is parsed for every record, so a record is judged alike whatever is selected of it.  A header
    with other names raises.  A file with line breaks in values cannot be cut: files are the unit of work.
    """
    schema = f"{REVIEWS if labelled else TEXTS}, {RECORD} string"
    rows = (spark.read.schema(schema).options(**FORMAT).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", RECORD).option("enforceSchema", False).option("columnPruning", False).csv(path))
    return rows.withColumn("problem", fault(labelled))


def load(spark: SparkSession, path: str, labelled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejects): the files are read once; rejects keep their values, ``record`` and ``problem``."""
    rows = materialize(read(spark, path, labelled), "annotated")
    return rows.where(F.col("problem").isNull()).drop(RECORD, "problem"), rows.where(F.col("problem").isNotNull())


def write(reviews: DataFrame, path: str) -> None:
    """Reviews as CSV files that ``read`` takes; every value is quoted, so that line breaks survive."""
    reviews.write.mode("overwrite").options(**FORMAT).option("quoteAll", True).csv(path)
