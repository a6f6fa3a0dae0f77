"""Look up the distinct keys of each row in a table, without exploding every occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize


def attach(df: DataFrame, keys: Column, table: DataFrame, key: str, values: list[str], out: str) -> DataFrame:
    """``df`` plus ``out``: array of (key, values...) for the row's distinct keys that ``table`` has.

    Rows are told apart by a number of their own, so null and repeated ids are no special
    case; the numbered rows are written once, which keeps the numbers if a task is repeated.
    A hot key occurs at most once per row; the table is broadcast by AQE only if its runtime
    size allows it, else both sides are shuffled on the key with skewed keys split.
    """
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    each = rows.select("__row", F.explode_outer(F.array_distinct(keys)).alias(key)).where(F.col(key).isNotNull())
    hits = each.join(table.select(key, *values), key).groupBy("__row").agg(F.collect_list(F.struct(key, *values)).alias(out))
    return rows.join(hits, "__row", "left").drop("__row")
