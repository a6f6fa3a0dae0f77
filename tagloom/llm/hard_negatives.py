"""Hard negatives of anchors, found by bounds along spanning trees of the anchors.

The anchors of a block are spanned by minimum spanning trees.  Along an edge of length e the score
of a row with norm r changes by at most e * r, so the interval known for the parent anchor, widened
by that, bounds the child's score.  Only rows whose interval meets what the child still looks for
are scored again; for the others the interval is handed down the tree.

Rows stay where they are: each task holds one block of anchors and passes over its rows.  There are
as many passes as blocks of ``BLOCK`` anchors, so what is broadcast does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import NO_ID, NO_SCORE, Best
from tagloom.session import materialize, remove_at_exit, scratch_path

BLOCK = 16384        # anchors that one pass over the rows serves
TREE = 1024          # anchors of one spanning tree
CHUNK = 2048         # rows that are bounded at once
DENSE = 8            # a level is scored as one product if more than one pair in DENSE is wanted
FOUND = "slot int, part int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; beyond the range of a long it saturates."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column, label: Column) -> Column:
    """Label and vector are there and every component is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


# --- vectors and trees -------------------------------------------------------------------

def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as int64; short rows end in zeros, components past ``width`` meet none."""
    column = column.cast(pa.large_list(pa.int64()))
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        w = min(width, int(sizes[0]))
        out[:, :w] = values.reshape(len(sizes), int(sizes[0]))[:, :w]
        return out
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(values)) - np.repeat(starts, sizes)
    keep = col < width
    out[row[keep], col[keep]] = values[keep]
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree; the root, nearest to the mean, is its own parent."""
    points = points.astype(np.float64)
    n = len(points)
    root = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    near, parent = np.full(n, np.inf), np.full(n, root)
    order, edge, open_ = np.empty(n, np.int64), np.zeros(n), np.ones(n, bool)
    at = root
    for step in range(n):
        order[step] = at
        open_[at] = False
        gap = ((points - points[at]) ** 2).sum(1)
        closer = open_ & (gap < near)
        near[closer], parent[closer] = gap[closer], at
        if step + 1 < n:
            left = np.where(open_, near, np.inf)
            at = int(np.argmin(left))
            if not open_[at]:                     # distances beyond the range of a double: any open point
                at = int(np.flatnonzero(open_)[0])
            edge[at] = np.sqrt(near[at])
    return order, parent, edge


def tree_levels(points: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, place of their parents in the level above, edge lengths), from the root down."""
    order, parent, edge = spanning_tree(points)
    depth, place, levels = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), []
    for v in order:
        depth[v] = 0 if parent[v] == v else depth[parent[v]] + 1
    for d in range(int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == d)
        place[here] = np.arange(len(here))
        levels.append((here + first, place[parent[here]], edge[here]))
    return levels


class Block:
    """A block of anchors with their trees; it is broadcast, so it holds ``BLOCK`` anchors at most."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: np.ndarray):
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.labels, self.vectors = labels, vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.trees = [tree_levels(vectors[i:i + TREE], i) for i in range(0, len(vectors), TREE)]


# --- scores ------------------------------------------------------------------------------

def scored(block: Block, rows: np.ndarray, row_labels: np.ndarray, same: bool, low, high) -> Iterator[tuple]:
    """(anchors, rows, exact scores) of all pairs that can lie in the anchors' windows, tree level by level.

    ``same``: pairs of equal or of different labels.  ``low()`` and ``high`` give the window of every
    anchor; ``low`` is asked again at each level, as it rises with what was found.
    """
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    scale = float(norms.max(initial=0) * block.norms.max(initial=0))
    exact = scale < 2.0 ** 52                       # doubles hold every score and partial sum
    kind = np.float64 if exact else np.int64
    x, a = rows.astype(kind), block.vectors.astype(kind, copy=False)
    slack = 1e-6 + 1e-15 * scale
    for tree in block.trees:
        lo = hi = None
        for anchors, parent, edge in tree:
            if lo is None or not exact:             # the root, or sums beyond doubles: no bound
                lo = np.full((len(anchors), len(x)), -np.inf)
                hi = np.full((len(anchors), len(x)), np.inf)
                wanted = np.ones(lo.shape, bool)
            else:
                reach = edge[:, None] * norms * (1 + 1e-9) + slack
                lo, hi = lo[parent] - reach, hi[parent] + reach
                wanted = ((hi >= low()[anchors, None]) & (lo <= high[anchors, None])
                          & ((row_labels == block.labels[anchors, None]) == same))
            at, row = np.nonzero(wanted)
            if not len(at):
                continue
            if len(at) * DENSE > wanted.size:
                s = (a[anchors] @ x.T)[at, row]
            else:
                s = np.concatenate([np.einsum("ij,ij->i", a[anchors[at[i:i + 65536]]], x[row[i:i + 65536]])
                                    for i in range(0, len(at), 65536)])
            if exact:
                lo[at, row] = hi[at, row] = s
            at = anchors[at]
            keep = ((s >= low()[at]) & (s <= high[at]) & ((row_labels[row] == block.labels[at]) == same))
            yield at[keep], row[keep], s[keep].astype(np.int64)


def chunks(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of rows, few at first: what they find narrows the windows for the rest."""
    size = 64
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            ids = part.column(0)
            ids = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            yield ids, part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2), width)
            at += size
            size = min(CHUNK, size * 2)


def found_rows(best: Best, parts: int) -> pa.RecordBatch:
    slot, rank = np.nonzero(best.score > NO_SCORE)
    ids = best.id[slot, rank]
    return pa.record_batch([pa.array(slot // parts, pa.int32()), pa.array(slot % parts, pa.int32()),
                            pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(best.score[slot, rank], pa.int64())],
                           names=["slot", "part", "id", "score"])


def first_of_all(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot over all tasks."""
    order = Window.partitionBy("slot", "part").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(rows: DataFrame, held, k: int) -> DataFrame:
    """The first ``k`` rows with the anchor's label and another id, of every anchor of a block."""
    def run(batches):
        block = held.value
        best = Best(len(block.ids), k)
        high = np.full(len(block.ids), np.inf)
        for ids, labels, x in chunks(batches, block.vectors.shape[1]):
            for at, row, s in scored(block, x, labels, True, lambda: best.floor(), high):
                other = ids[row] != block.ids[at]
                best.add(at[other], s[other], ids[row[other]])
        yield found_rows(best, 1)

    return first_of_all(rows.mapInArrow(run, FOUND), k)


def negatives(rows: DataFrame, held, windows, k: int) -> DataFrame:
    """The first ``k`` rows of another label in the window of every anchor and positive of a block.

    ``windows.value`` is (least, greatest score) as int64 arrays of anchors x positives; an empty
    window has its least above its greatest.
    """
    def run(batches):
        block, (least, most) = held.value, windows.value
        parts = least.shape[1]
        best = Best(least.size, k)
        empty = least > most
        high = np.where(empty, -np.inf, most).max(1)

        def low():
            return np.where(empty, np.inf, np.maximum(least, best.floor().reshape(least.shape))).min(1)

        for ids, labels, x in chunks(batches, block.vectors.shape[1]):
            for at, row, s in scored(block, x, labels, False, low, high):
                for p in range(parts):
                    slot = at * parts + p
                    fits = (s >= np.maximum(least[at, p], best.floor()[slot])) & (s <= most[at, p])
                    best.add(slot[fits], s[fits], ids[row[fits]])
        yield found_rows(best, parts)

    return first_of_all(rows.mapInArrow(run, FOUND), k)


# --- the operator ------------------------------------------------------------------------

def window(score: int, floor: int, ceiling: int) -> tuple[int, int]:
    """Negative scores with floor * score <= 100 * negative <= ceiling * score, as long bounds."""
    return -(-floor * score // 100), ceiling * score // 100


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3,
         floor: int = 50, ceiling: int = 95) -> DataFrame:
    """Hard negatives of every anchor and positive (``RESULT``).

    ``rows`` is (vec_id long, label, vector array<long>); rows with a null label or vector must have
    been left out (``usable``).  Positives are an anchor's ``n_positives`` best-scored rows of its
    label, negatives the ``n_negatives`` best-scored rows of other labels whose score lies between
    ``floor`` and ``ceiling`` per cent of the positive's.  Equal scores: the smaller id, null last.

    Rows with the anchor's own id are not its positives.  Repeated rows each count, repeated anchors
    each give their rows.  Vectors of other lengths are compared as if they ended in zeros.
    Scores are 64-bit: sums beyond that wrap.  An empty table, or no anchor, gives no rows; other
    columns of ``rows`` are not looked at.
    """
    spark = rows.sparkSession
    table = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                    F.col("vector").cast("array<long>").alias("vector"),
                                    F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "vectors")
    anchors = table.where("anchor").drop("anchor")
    n_blocks = -(-anchors.count() // BLOCK)
    if n_blocks > 1:                                # dealt in turn, so no id or label fills one block
        anchors = materialize(anchors.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks))), "anchors")
    rows, out = table.drop("anchor"), scratch_path(spark, "negatives")
    for b in range(n_blocks):
        got = (anchors.where(F.col("block") == b).drop("block") if n_blocks > 1 else anchors).toArrow()
        got = got.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        block = Block(got.column(0).to_pylist(), got.column(1).to_numpy(), matrix(got.column(2).combine_chunks()))
        held = spark.sparkContext.broadcast(block)
        first = positives(rows, held, n_positives).collect()
        least = np.full((len(block.ids), n_positives), 1, np.int64)
        most = np.zeros((len(block.ids), n_positives), np.int64)
        pairs = []
        for r in first:
            at = r["slot"], r["rank"] - 1
            least[at], most[at] = window(r["score"], floor, ceiling)
            own = int(block.ids[r["slot"]])
            pairs.append((at[0], at[1], None if own == NO_ID else own, r["id"], r["score"]))
        windows = spark.sparkContext.broadcast((least, most))
        known = spark.createDataFrame(pairs, "slot int, part int, anchor_id long, positive_id long, positive_score long")
        done = (negatives(rows, held, windows, n_negatives).join(F.broadcast(known), ["slot", "part"])
                .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score")))
        if n_blocks == 1:
            return done
        done.write.mode("append").parquet(out)
        if b == 0:
            remove_at_exit(spark, out)
        held.destroy()
        windows.destroy()
    return spark.read.schema(RESULT).parquet(out) if n_blocks else spark.createDataFrame([], RESULT)
