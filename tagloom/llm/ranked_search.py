"""Ranked lexical search on K2-treaps over the term-document grid.

A shard of documents is a grid of terms by documents whose cells hold the term's impact on the
document.  It is stored as a quadtree of the non-empty cells: each node has four bits for its
quadrants, the place of its first child and the greatest impact below it.  A query follows the row
paths of its terms jointly: a range of documents is bounded by the sum of the maxima of the nodes in
which the terms' rows meet it.  Ranges are opened best first, until none can beat the results.

Terms are maximal runs of letters, digits and characters past ASCII, A-Z in lower case.  Impacts are
64-bit integers, so equal scores are real ties.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import common as C
from tagloom.llm.common import NO_ID, NO_SCORE, Best
from tagloom.session import materialize, remove_at_exit, scratch_path

SHARD_CELLS = 1 << 19          # cells of a shard, unless one document has more
SHARD_DOCS = 1 << 13           # documents of a shard
QUERY_CELLS = 1 << 22          # terms x documents that are searched together
BLOCK_BYTES = 32 << 20         # terms of the queries that one pass over the documents serves
WIDTH = 16                     # ranges opened at first for each query; more in every round
TERM = C.lut([*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
CHILD = np.array([[bin(mask & ((1 << q) - 1)).count("1") if mask >> q & 1 else -1 for q in range(4)] for mask in range(16)])


# --- terms -------------------------------------------------------------------------------

class Vocabulary:
    """The terms of a block of queries, found in documents by their hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        hashes = np.array([C.string_hash(t) for t in terms], np.uint64)
        order = np.argsort(hashes)
        self.hash, self.number = hashes[order], order
        if len(hashes) > 1 and (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of the queries have one hash")
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)

    def postings(self, data: np.ndarray, offs: np.ndarray) -> tuple:
        """Per text: how many terms it has, and the numbers and counts of those that queries have."""
        data = LOWER[data]
        starts, ends = C.runs(TERM[data].view(np.uint8), offs)
        edges = np.searchsorted(starts, offs)
        if not len(self.hash):
            starts = starts[:0]
        at = np.empty(0, np.int64)
        if len(starts):
            h = C.SpanHash(data)(starts, ends)
            place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            at = np.flatnonzero(self.hash[place] == h)
        number = self.number[place[at]] if len(at) else at
        if len(at):
            same = self._same(data, starts[at], ends[at], number)
            at, number = at[same], number[same]
        row = np.searchsorted(offs, starts[at], "right") - 1 if len(at) else at
        key, times = np.unique(row * np.int64(max(1, len(self.hash))) + number, return_counts=True)
        row, number = key // max(1, len(self.hash)), key % max(1, len(self.hash))
        cut = pa.array(np.searchsorted(row, np.arange(len(offs))), pa.int32())
        return (np.diff(edges), pa.ListArray.from_arrays(cut, pa.array(number, pa.int32())),
                pa.ListArray.from_arrays(cut, pa.array(times, pa.int32())))

    def _same(self, data, starts, ends, number) -> np.ndarray:
        s, e = self.offs[number], self.offs[number + 1]
        if C.same_bytes(data, starts, ends, s, e, self.data):
            return np.ones(len(starts), bool)
        return np.array([data[a:b].tobytes() == self.data[c:d].tobytes() for a, b, c, d in zip(starts, ends, s, e)], bool)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms array<binary>, times array<long>, bytes): one row per query, numbered."""
    find = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall
    lower = bytes(LOWER.tolist())
    id_type = items.schema[id_col].dataType
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("terms", T.ArrayType(T.BinaryType())),
                           T.StructField("times", T.ArrayType(T.LongType())), T.StructField("bytes", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [Counter(find((t or "").encode().translate(lower))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                 pa.array([sum(len(t) + 16 for t in c) for c in found], pa.int64())], names=schema.names)

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, schema).withColumn("item", F.monotonically_increasing_id()), "queries")


# --- the quadtree ------------------------------------------------------------------------

class Treap:
    """K2-treap of a grid: per level the quadrant bits, first children and maxima of its nodes, in Morton order."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, side: int):
        self.height = max(1, (side - 1).bit_length())
        code = np.zeros(len(rows), np.int64)
        for i in range(self.height):
            code |= ((rows >> i) & 1) << (2 * i + 1) | ((cols >> i) & 1) << (2 * i)
        order = np.argsort(code)
        code, best = code[order], values[order]
        levels = [(None, None, best)]
        for _ in range(self.height):
            up = code >> 2
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            bits = np.bitwise_or.reduceat(np.left_shift(1, code & 3), first).astype(np.uint8)
            best = np.maximum.reduceat(best, first)
            levels.append((bits, first, best))
            code = up[first]
        self.levels = levels[::-1]

    def descend(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child or -1, its maximum or 0) of each node's quadrant."""
        bits, first, _ = self.levels[level]
        step = CHILD[bits[node], quadrant]
        child = np.where(step >= 0, first[node] + step, -1)
        return child, np.where(step >= 0, self.levels[level + 1][2][child], 0)


class Ranges:
    """Open ranges of documents at one level of the tree; per range the nodes that its query's terms reach."""

    def __init__(self, query, col, bound, offs, node, term):
        self.query, self.col, self.bound, self.offs, self.node, self.term = query, col, bound, offs, node, term

    def __len__(self) -> int:
        return len(self.query)

    def take(self, keep: np.ndarray) -> "Ranges":
        sizes = np.diff(self.offs)
        at = C.gather(self.offs[:-1][keep], sizes[keep])
        return Ranges(self.query[keep], self.col[keep], self.bound[keep],
                      np.concatenate([[0], np.cumsum(sizes[keep])]), self.node[at], self.term[at])

    def and_(self, other: "Ranges | None") -> "Ranges":
        if other is None:
            return self
        return Ranges(*[np.concatenate([a, b]) for a, b in ((self.query, other.query), (self.col, other.col), (self.bound, other.bound))],
                      np.concatenate([self.offs, other.offs[1:] + self.offs[-1]]),
                      np.concatenate([self.node, other.node]), np.concatenate([self.term, other.term]))


def halves(tree: Treap, level: int, at: Ranges, row: np.ndarray, times: np.ndarray) -> Ranges:
    """The two halves of every range, as far as any term reaches them."""
    owner = np.repeat(np.arange(len(at)), np.diff(at.offs))
    down = (row[at.term] >> (tree.height - 1 - level)) & 1
    parts = []
    for side in (0, 1):
        child, best = tree.descend(level, at.node, down * 2 + side)
        live = child >= 0
        parts.append((owner[live] * 2 + side, child[live], at.term[live], best[live] * times[at.term[live]]))
    half, node, term, value = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(half, kind="stable")
    half, node, term, value = half[order], node[order], term[order], value[order]
    here = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]])) if len(half) else np.empty(0, np.int64)
    bound = np.add.reduceat(value, here) if len(here) else np.empty(0, np.int64)
    half = half[here]
    return Ranges(at.query[half >> 1], at.col[half >> 1] * 2 + (half & 1), bound, np.append(here, len(node)), node, term)


def search(tree: Treap, doc_ids: np.ndarray, query: np.ndarray, row: np.ndarray, times: np.ndarray, best: Best) -> None:
    """Enter the shard's best documents of each query into ``best``.

    ``query`` (ascending), ``row`` and ``times`` list the queries' terms.  ``doc_ids`` are the columns',
    ascending, so that of equal scores a range of later documents need not be opened.
    """
    names, first = np.unique(query, return_index=True)
    open_: dict[int, Ranges] = {0: Ranges(names, np.zeros(len(names), np.int64), np.full(len(names), np.iinfo(np.int64).max),
                                          np.append(first, len(query)), np.zeros(len(query), np.int64), np.arange(len(query)))}
    width = WIDTH

    def hopeful(level: int, at: Ranges) -> np.ndarray:
        least, last = best.score[at.query, -1], best.id[at.query, -1]
        return (at.bound > least) | ((at.bound == least) & (doc_ids[at.col << (tree.height - level)] < last))

    while open_:
        for level in list(open_):
            open_[level] = open_[level].take(np.flatnonzero(hopeful(level, open_[level])))
            if not len(open_[level]):
                del open_[level]
        if not open_:
            return
        levels = sorted(open_)
        owner = np.concatenate([open_[v].query for v in levels])
        order = np.lexsort((-np.concatenate([open_[v].bound for v in levels]), owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen, at = rank < width, 0
        width *= 2
        for level in levels:
            ranges, mine = open_[level], chosen[at:at + len(open_[level])]
            at += len(ranges)
            open_[level] = ranges.take(np.flatnonzero(~mine))
            new = halves(tree, level, ranges.take(np.flatnonzero(mine)), row, times)
            if level + 1 == tree.height:
                keep = hopeful(level + 1, new)
                best.add(new.query[keep], new.bound[keep], doc_ids[new.col[keep]])
            elif len(new):
                open_[level + 1] = new.and_(open_.get(level + 1))


# --- the operator ------------------------------------------------------------------------

class Queries:
    """A block of queries with the weights and rows of their terms; it is broadcast."""

    def __init__(self, ids: list, query: np.ndarray, term: np.ndarray, times: np.ndarray):
        self.ids, self.query, self.term, self.times = ids, query, term, times

    def weigh(self, n_terms: int, df: dict[int, int], n_docs: int, total: int) -> None:
        self.n_docs, self.total = n_docs, total
        self.weight = np.zeros(n_terms, np.int64)
        for t, n in df.items():
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.row = np.empty(n_terms, np.int64)         # rows of like weights lie together, which tightens the maxima
        self.row[np.argsort(-self.weight, kind="stable")] = np.arange(n_terms)
        found = self.weight[self.term] > 0
        self.query, self.term, self.times = self.query[found], self.term[found], self.times[found]


def shards(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc ids, lengths, columns, terms, counts) of about ``SHARD_CELLS`` postings of whole documents."""
    held, cells, docs = [], 0, 0

    def cut():
        ids, n, sizes, terms, times = (np.concatenate(p) for p in zip(*held))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return ids[order], n[order], np.repeat(rank, sizes), terms, times

    for batch in batches:
        at = 0
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        reach = np.cumsum(sizes)
        while at < batch.num_rows:
            before = reach[at - 1] if at else 0
            end = min(int(np.searchsorted(reach, before + SHARD_CELLS - cells, "right")), at + SHARD_DOCS - docs)
            end = min(batch.num_rows, max(end, at if held else at + 1))
            if end > at:
                part = batch.slice(at, end - at)
                ids = part.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                held.append((ids, part.column(1).to_numpy(zero_copy_only=False), sizes[at:end],
                             part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                             part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                cells, docs = cells + int(sizes[at:end].sum()), docs + end - at
            if end < batch.num_rows:
                yield cut()
                held, cells, docs = [], 0, 0
            at = end
    if held:
        yield cut()


def ranked(postings: DataFrame, held, k: int) -> DataFrame:
    """(query, doc_id, score): each task's first ``k`` documents of every query."""
    def run(batches):
        q = held.value
        best = Best(len(q.ids), k)
        for ids, n, col, term, times in shards(batches):
            m = 100 - 25 + (25 * n.astype(np.int64) * q.n_docs) // q.total
            impact = q.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[col]))
            cells = impact > 0
            if not cells.any() or not len(q.query):
                continue
            tree = Treap(q.row[term[cells]], col[cells], impact[cells], max(len(q.row), len(ids)))
            at, group = 0, max(1, QUERY_CELLS // len(ids))
            while at < len(q.query):                   # whole queries, about ``group`` terms at a time
                end = int(np.searchsorted(q.query, q.query[min(at + group, len(q.query)) - 1], "right"))
                search(tree, ids, q.query[at:end], q.row[q.term[at:end]], q.times[at:end], best)
                at = end
        slot, rank = np.nonzero(best.score > NO_SCORE)
        ids = best.id[slot, rank]
        yield pa.record_batch([pa.array(slot, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
                               pa.array(best.score[slot, rank], pa.int64())], names=["query", "doc_id", "score"])

    return postings.mapInArrow(run, "query int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: (item_id, rank int, doc_id long, score long).

    With N documents that have a term, L their terms, n one document's, df the documents that hold a
    term and tf its occurrences in the document, a term's weight is floor(1000 ln((2N+2)/(2df+1))),
    m = 75 + 25 n N div L, and its impact weight * ((10^9 tf) div (1000 tf + 12 m)); an item's terms count
    as often as it repeats them.  Only scores above 0; equal scores by doc_id, null last.

    Items and documents are rows: repeated ids stand for themselves, and each row of an item gets its
    own ranks.  A null or empty text has no term.  Empty tables, or items without a term that a
    document holds, give no rows; other columns are not looked at.

    Items are taken in blocks of ``BLOCK_BYTES`` of terms, each with a pass over all documents, so what
    is broadcast does not grow with the items; one item's terms stay together.
    """
    spark = docs.sparkSession
    asked = query_terms(items, item_id, item_text)
    n_blocks = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out, totals, found = scratch_path(spark, "ranked"), None, None
    id_type = items.schema[item_id].dataType.simpleString()
    for b in range(n_blocks):
        got = asked.where(F.pmod("item", F.lit(n_blocks)) == b).select("item", "item_id", "terms", "times").toArrow().sort_by("item")
        sizes = [len(t) for t in got.column("terms").to_pylist()]
        flat = [t for row in got.column("terms").to_pylist() for t in row]
        number = {t: i for i, t in enumerate(sorted(set(flat)))}
        queries = Queries(got.column("item_id").to_pylist(), np.repeat(np.arange(len(sizes)), sizes),
                          np.array([number[t] for t in flat], np.int64),
                          np.array([n for row in got.column("times").to_pylist() for n in row], np.int64))
        words = spark.sparkContext.broadcast(Vocabulary(list(number)))
        found, name = C.add_columns(rows, "text", [("n", "long"), ("terms", "array<int>"), ("times", "array<int>")],
                                    lambda data, offs, words=words: words.value.postings(data, offs))
        postings = materialize(found.select("doc_id", f"{name}.n", f"{name}.terms", f"{name}.times"), "postings")
        if totals is None:
            totals = postings.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
        df = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        queries.weigh(len(number), {r["term"]: r["count"] for r in df}, totals["docs"] or 0, totals["terms"] or 0)
        held = spark.sparkContext.broadcast(queries)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = (ranked(postings.where(F.size("terms") > 0), held, k)
                 .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {id_type}")
        done = first.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        if n_blocks == 1:
            return done
        done.write.mode("append").parquet(out)
        if b == 0:
            remove_at_exit(spark, out)
        words.destroy()
        held.destroy()
    return spark.read.schema(done.schema).parquet(out)
