"""Deterministic sampling, splitting and batching.

Randomness is ``md5(concat(seed, ':', key))`` so any engine reproduces it.  Exact global
ranks (for ``sample with replacement`` and batching) use a scalable dense index instead
of an unpartitioned ``row_number``: rows are bucketed by the first four hex digits of
their hash (65,536 ordered buckets), bucket sizes are summed into offsets over that
bounded table, and the rank is ``offset + row_number() within the bucket``.  Only the
bucket-size table (at most 65,536 rows per group, a proven bound) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.constants import BATCH_SIZE, SEED
from tagloom.session import materialize

SPLIT_THRESHOLD = "e6666666"          # 0.9 of the 32-bit hash range


def hash_key(key, seed: int | str = SEED) -> "F.Column":
    """md5 of seed and key as text; a null key counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def hash_int(h) -> "F.Column":
    """First 60 bits of a hex md5 as a non-negative long."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def split_90_10(df: DataFrame, key: str = "id", seed: int = SEED) -> DataFrame:
    """Map-side split, train iff the hash prefix is below 0.9 of the range."""
    return df.withColumn("split", F.when(F.substring(hash_key(key, seed), 1, 8) < SPLIT_THRESHOLD,
                                         F.lit("train")).otherwise(F.lit("val")))


def dense_rank_by_hash(df: DataFrame, h: str, key: str, group: list[str] | None = None,
                       out: str = "idx", ties: list[str] | None = None) -> DataFrame:
    """0-based rank of each row ordered by (h, key, ties) within ``group``, without a global sort.

    ``group`` must have few values (it is used for splits): the broadcast bucket sizes are at most
    65,536 rows for each.  A bucket is sorted in one task, so a table of more than some 10^10 rows
    wants a longer prefix.  Rank keys alone and join the rows last if they are wide.
    """
    group = group or []
    b = df.withColumn("__b", F.substring(F.col(h), 1, 4))
    sizes = b.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*group, "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    within = Window.partitionBy(*group, "__b").orderBy(h, key, *(ties or []))
    return (b.join(F.broadcast(offs), group + ["__b"])
            .withColumn(out, (F.col("__off") + F.row_number().over(within) - 1).cast("long"))
            .drop("__b", "__off"))


def dense_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """0-based place of each row in the order of ``order``, then of the other columns.

    The rows are sorted over ranges and numbered inside each; the driver adds up one count a range.
    Equal rows have places of their own.  ``df`` is written once.
    """
    columns = [*order, *[c for c in df.columns if c not in order]]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(placed, "ordered")
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, n = [], 0
    for p, size in sizes:
        offsets.append((p, n))
        n += size
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __off long"))          # one row a range
    seen = rows.withColumn("__part", part).join(small, "__part")
    return seen.withColumn(out, F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, out)


def debug_head(df: DataFrame, n: int = 500, key: str = "id") -> DataFrame:
    """First n rows by key (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(key).limit(n)


def sample_n(df: DataFrame, n: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """Exactly n rows without replacement (or all when fewer)."""
    return df.withColumn("__h", hash_key(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def sample_with_replacement(df: DataFrame, key: str = "id", factor: int = 2, seed: int = SEED) -> DataFrame:
    """``factor * N`` draws with replacement -> (draw, picked rows...).

    Each row spawns ``factor`` draw numbers, so the draws are generated where the data is
    (no driver-side count or range); draw d picks row ``hash(seed, d) mod N`` through an
    equi-join on the dense index.  A row is picked about ``factor`` times on average, so
    the join has no hot key.  What is drawn are rows: repeated and null keys are rows of their own.
    Wide rows are numbered in a written table, so that only keys and numbers are ranked and drawn and
    the rows are joined last.
    """
    wide = df.columns != [key]
    if wide:
        df = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    own = ["__row"] if wide else []
    ranked = dense_rank_by_hash(df.select(key, *own).withColumn("__h", hash_key(key, seed)), "__h", key, ties=own)
    n = df.agg(F.count(F.lit(1))).scalar()
    draws = ranked.select(F.explode(F.sequence(F.col("idx") * factor, F.col("idx") * factor + factor - 1))
                          .alias("draw"))
    draws = draws.withColumn("pick", F.pmod(hash_int(F.md5(F.concat(
        F.lit(f"{seed}:draw:"), F.col("draw").cast("string")))), n))
    drawn = draws.join(ranked.drop("__h"), draws["pick"] == ranked["idx"])
    if not wide:
        return drawn.select("draw", key)
    return drawn.select("draw", "__row").join(df, "__row").select("draw", *[c for c in df.columns if c != "__row"])


def batches(df: DataFrame, key: str = "id", split: str = "split", size: int = BATCH_SIZE,
            seed: int = SEED + 1) -> DataFrame:
    """Batches of ``size`` within each split, shuffled over the whole table; only the last one is partial.

    The order is the hash's over all rows, so the rows are shuffled; ``batches_in_place`` leaves them
    where they are.
    """
    ranked = dense_rank_by_hash(df.withColumn("__h", hash_key(key, seed)), "__h", key, group=[split])
    return ranked.withColumn("batch_id", (F.col("idx") / F.lit(size)).cast("long")).drop("__h")


def batches_in_place(df: DataFrame, key: str = "id", split: str = "split", size: int = BATCH_SIZE,
                     seed: int = SEED + 1, out: str = "batch_id") -> DataFrame:
    """L05 without a shuffle of the rows: each partition's rows in hash order, numbered on from the partitions before.

    A partition is sorted by (split, hash, key) and written once; its places are numbers of its own.  What
    crosses partitions is one count a partition and split: their running sum per split is what is added.
    So batches are full but for the last one of each split, whatever the number of partitions; a batch
    may begin in one partition and end in the next.  A null split is a split of its own; repeated and
    null keys are rows of their own.  ``split`` must have few values.
    """
    placed = (df.withColumn("__h", hash_key(key, seed)).sortWithinPartitions(split, "__h", key)
              .withColumn("__at", F.monotonically_increasing_id()).drop("__h"))
    rows = materialize(placed, "in-place").withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part", F.col(split).alias("__split")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    before = Window.partitionBy("__split").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("__part").alias("__p"), "__split",
                         (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")).alias("__shift"))
    # one row for each partition and split
    numbered = rows.join(F.broadcast(shift), (F.col("__part") == F.col("__p")) & F.col(split).eqNullSafe(F.col("__split")))
    place = F.col("__at") + F.col("__shift")
    return numbered.withColumn(out, F.floor(place / F.lit(size)).cast("long")).select(*[c for c in df.columns if c != out], out)
