"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, name: str = "components", rounds: int = 100) -> DataFrame:
    """(u, root) for every node of ``links`` (u, v) that is not its component's least node.

    Each round replaces every link by links to the least neighbour, first seen from the smaller
    end, then from the larger one, until nothing changes: then every node links to its root.
    Per round two joins and map-side combined minima, linear in the links; a hub's links are a
    skewed inner join, which Spark splits.  Each round's links are written to the shared folder,
    which cuts the lineage.
    """
    down = (links.where("u is not null and v is not null and u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    down = materialize(down, name)
    state = None
    for _ in range(rounds):
        both = down.union(down.select("v", "u"))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, name)
        least = _least_neighbour(large)
        small = (large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        down = materialize(small, name)
        now = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return down.select("u", F.col("v").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
