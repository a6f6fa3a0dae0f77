"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a few megabytes of whole training texts.  Its words become symbols: a
benchmark word its number, any run of other words (which no benchmark phrase can cross) and every
text edge a separator.  The shard's suffix array is sorted by prefix doubling, its Burrows-Wheeler
transform is stored as a wavelet matrix, and text positions are kept for a sample of the suffixes.
All phrases are then searched backwards at once through the wavelet ranks, occurrences are located
by walking to the nearest sampled suffix, and the hit words are merged into removal spans.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.  A phrase is 13
consecutive words of an item, or a whole item of fewer words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import common as C
from tagloom.session import materialize, remove_at_exit, scratch_path

PHRASE = 13
SHARD_BYTES = 4 << 20
SAMPLE = 8
BLOCK_BYTES = 16 << 20          # benchmark text of one broadcast block, and of one pass over the documents
FIELDS = [("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("spans", "array<long>")]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = C.lut([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a slice."""
    data = _LOWER[data]
    starts, ends = C.runs(_WORD[data].view(np.int8), offs)
    return C.SpanHash(data)(starts, ends), starts, ends


# --- the test phrases --------------------------------------------------------------------

def phrases(item_ids: list, texts: list) -> dict:
    """Vocabulary, phrase matrix (symbols, right-aligned) and the items of each phrase."""
    data, offs = C.utf8(pa.array(texts, pa.string()))
    h, starts, _ = word_hashes(data, offs)
    vocab = np.unique(h)
    symbol = np.searchsorted(vocab, h) + 1
    first = np.searchsorted(starts, offs)
    rows, items = [], []
    for i in range(len(texts)):
        own = symbol[first[i]:first[i + 1]]
        for j in range(max(min(len(own), 1), len(own) - PHRASE + 1)):
            part = own[j:j + PHRASE]
            rows.append(np.concatenate([np.zeros(PHRASE - len(part), np.int32), part.astype(np.int32)]))
            items.append(i)
    matrix, back = np.unique(np.array(rows, np.int32).reshape(-1, PHRASE), axis=0, return_inverse=True)
    back = back.reshape(-1)
    order = np.argsort(back, kind="stable")
    return {"vocab": vocab, "matrix": matrix, "length": (matrix > 0).sum(1),
            "items": np.array(items, np.int64)[order], "items_from": np.searchsorted(back[order], np.arange(len(matrix) + 1)),
            "ids": [None if x is None else str(x) for x in item_ids]}


def blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text) of the benchmark, and in how many blocks of about ``BLOCK_BYTES`` it is searched."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, max(1, math.ceil(size / BLOCK_BYTES))


def block(rows: DataFrame, n: int, b: int):
    """The broadcast phrase table of block ``b``; repeated texts fall in one block, and one text is never cut."""
    part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()
    return rows.sparkSession.sparkContext.broadcast(phrases([r["item_id"] for r in part], [r["text"] for r in part]))


# --- the index ---------------------------------------------------------------------------

def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array of symbols >= 0 ending in 0, where every 0 is a separator of its own.

    Separators order by position, so two suffixes that reach separators together are in text
    order; only those equal on words alone need the doubling rounds.
    """
    n = len(seq)
    place = max(1, int(n - 1).bit_length())
    width = max(1, int(seq.max()).bit_length())
    depth = max(1, (64 - place) // width)
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(depth):
        part = np.zeros(n, np.uint64)
        part[:max(0, n - j)] = seq[j:]
        alive &= part > 0
        key = key << np.uint64(width) | np.where(alive, part, np.uint64(0))
    packed = np.sort(key << np.uint64(place) | np.arange(n, dtype=np.uint64))
    sa = (packed & np.uint64((1 << place) - 1)).astype(np.int64)
    prefix = packed >> np.uint64(place)
    open_ = (prefix & np.uint64((1 << width) - 1)) > 0
    new = np.ones(n, bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | ~open_[1:]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[sa[slots]] = slots[head]
        size = np.bincount(head, minlength=len(slots))[head]
        tied = size > 1
        if not tied.any():
            return sa
        slots = slots[tied]
        at = sa[slots]
        key = rank[at] * n + rank[at + depth]
        order = np.argsort(key)
        sa[slots] = at[order]
        key = key[order]
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        depth *= 2


class FmIndex:
    """Count and locate phrases in a separated symbol sequence."""

    def __init__(self, seq: np.ndarray, symbols: int):
        sa = suffix_array(seq)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 1))])
        cur = seq[sa - 1]
        # positions are kept for every SAMPLE-th suffix and for those after a separator
        self.sampled = (sa % SAMPLE == 0) | (cur == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled, dtype=np.int32)])
        self.samples = sa[self.sampled].astype(np.int32)
        self.levels = []
        for b in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = (cur >> b) & 1
            zeros = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.levels.append((b, zeros))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``row`` in the transform."""
        base = np.zeros_like(row)
        for b, zeros in self.levels:
            one = (symbol >> b) & 1
            z, z0, total = zeros[row], zeros[base], zeros[-1]
            row = np.where(one, total + row - z, z)
            base = np.where(one, total + base - z0, z0)
        return row - base

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The transform's symbol at ``row``."""
        out = np.zeros_like(row)
        for b, zeros in self.levels:
            z = zeros[row]
            one = zeros[row + 1] == z
            out |= one.astype(row.dtype) << b
            row = np.where(one, zeros[-1] + row - z, z)
        return out

    def search(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of right-aligned phrases, by backward search."""
        lo = self.before[matrix[:, -1]].astype(np.int64)
        hi = self.before[matrix[:, -1] + 1].astype(np.int64)
        for j in range(matrix.shape[1] - 2, -1, -1):
            live = np.flatnonzero((hi > lo) & (matrix[:, j] > 0))
            if not len(live):
                break
            c = matrix[live, j]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk back until a sampled one, then add the steps."""
        out, at, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(at):
            known = self.sampled[row]
            out[at[known]] = self.samples[self.sample_rank[row[known]]] + steps
            at, row = at[~known], row[~known]
            c = self.symbol(row)
            row = self.before[c] + self.rank(c, row)
            steps += 1
        return out


def shard_sequence(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, word of each entry): one 0 before every run of benchmark words, and at the end."""
    known = symbol > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    edge = first[first < len(symbol)]
    opens[edge] = known[edge]
    words = np.flatnonzero(known)
    place = np.arange(len(words)) + np.cumsum(opens[words])
    seq = np.zeros(len(words) + int(opens.sum()) + 1, np.int64)
    seq[place] = symbol[words]
    word = np.full(len(seq), -1, np.int64)
    word[place] = words
    return seq, word


def scan(data: np.ndarray, offs: np.ndarray, tables: list[dict]) -> list:
    """``FIELDS`` of every text of a shard."""
    n = len(offs) - 1
    h, starts, ends = word_hashes(data, offs)
    first = np.searchsorted(starts, offs)
    edges = np.zeros(len(h) + 1, np.int64)
    items: list[set] = [set() for _ in range(n)]
    for t in tables:
        if not len(t["matrix"]) or not len(h):
            continue
        at = np.minimum(np.searchsorted(t["vocab"], h), len(t["vocab"]) - 1)
        symbol = np.where(t["vocab"][at] == h, at + 1, 0)
        seq, word = shard_sequence(symbol, first)
        if len(seq) < 2:
            continue
        index = FmIndex(seq, len(t["vocab"]))
        lo, hi = index.search(t["matrix"])
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        if not len(found):
            continue
        phrase = np.repeat(found, count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
        begin = word[index.locate(rows)]
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + t["length"][phrase], -1)
        text = np.searchsorted(first, begin, "right") - 1
        for d, p in np.unique(np.stack([text, phrase], 1), axis=0).tolist():
            items[d].update(t["ids"][i] for i in t["items"][t["items_from"][p]:t["items_from"][p + 1]])
    hit = np.cumsum(edges)[:-1] > 0
    a, b = C.runs(hit.view(np.int8), first)
    text = np.searchsorted(first, a, "right") - 1
    spans: list[list] = [[] for _ in range(n)]
    for d, s, e in zip(text.tolist(), starts[a].tolist(), ends[b - 1].tolist()):
        spans[d] += [s - int(offs[d]), e - int(offs[d])]
    return [np.diff(first), C.per_text(hit, first), [sorted(x for x in s if x is not None) for s in items], spans]


def without(raw: bytes, spans: list) -> str:
    """A text without its (flat, ascending) spans."""
    keep = [0, *spans, len(raw)]
    return b"".join(raw[keep[k]:keep[k + 1]] for k in range(0, len(keep), 2)).decode("utf-8", "replace")


def search_block(docs: DataFrame, table, text: str, cut: bool) -> tuple[DataFrame, str]:
    def make(data, offs):
        out = [[] for _ in FIELDS]
        for _, _, part, own in C.slices(data, offs, SHARD_BYTES):
            for a, b in zip(out, scan(part, own, [table.value])):
                a.extend(b)
        if cut:
            raw = data.tobytes()
            out.append([without(raw[offs[i]:offs[i + 1]], spans) if spans else None for i, spans in enumerate(out[3])])
        return out

    return C.add_columns(docs, text, FIELDS + [("rest", "string")] * cut, make, "leak")


def united(pairs: np.ndarray) -> np.ndarray:
    """The union of (start, end) rows, ascending; those that touch are one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[first, 0], reach[np.append(np.flatnonzero(first)[1:], len(pairs)) - 1]], 1)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", cut: bool = False) -> tuple[DataFrame, str]:
    """``docs`` plus a struct column: n_words, n_hit, items, spans (bytes, flat pairs), and the name.

    With ``cut`` the struct also has ``rest``, the text without its spans.  Null texts have no
    words (``rest``: null stays null); items without words or with a null text match nothing; a
    null item_id's phrases are searched but it is not listed.  Repeated items are listed once.

    A benchmark of more than one block is searched block after block, with one pass over the numbered
    documents and one broadcast each; the rows with hits are written and united per document.
    """
    rows, n = blocks(benchmark)
    if n == 1:
        return search_block(docs, block(rows, 1, 0), text, cut)
    spark = docs.sparkSession
    number, hits, leak = C.unused(docs, "leak_row"), C.unused(docs, "leak_hits"), C.unused(docs, "leak")
    base = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "leak-documents")
    texts, path = base.select(F.col(number).alias("row"), F.col(text).cast("string").alias("text")), scratch_path(spark, "leak-hits")
    for b in range(n):
        table = block(rows, n, b)
        found, s = search_block(texts, table, "text", False)
        found.where(F.col(f"{s}.n_hit") > 0).select("row", f"{s}.items", f"{s}.spans").write.mode("append").parquet(path)
        if b == 0:
            remove_at_exit(spark, path)
        table.destroy()
    each = spark.read.schema("row long, items array<string>, spans array<bigint>").parquet(path)
    each = each.groupBy(F.col("row").alias(number)).agg(F.struct(F.flatten(F.collect_list("items")).alias("items"),
                                                                 F.flatten(F.collect_list("spans")).alias("spans")).alias(hits))
    joined = base.join(each, number, "left").drop(number)
    at, hits_at = joined.columns.index(text), joined.columns.index(hits)
    fields = FIELDS + [("rest", "string")] * cut
    struct = T.StructType([T.StructField(f, T._parse_datatype_string(t)) for f, t in fields])
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != hits], T.StructField(leak, struct)])

    def unite(batches):
        for batch in batches:
            got, parts = batch.column(hits_at).to_pylist(), [[] for _ in fields]
            for lo, _, data, offs in C.slices(*C.utf8(batch.column(at))):
                _, starts, ends = word_hashes(data, offs)
                first, raw = np.searchsorted(starts, offs), data.tobytes()
                for i, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    own = got[lo + i] or {"items": [], "spans": []}
                    flat, hit = [], 0
                    if own["spans"]:                               # in words, so that runs beside each other become one
                        begin, end = starts[first[i]:first[i + 1]] - a, ends[first[i]:first[i + 1]] - a
                        runs = united(np.searchsorted(begin, np.array(own["spans"], np.int64)).reshape(-1, 2))
                        hit = int((runs[:, 1] - runs[:, 0]).sum())
                        flat = np.stack([begin[runs[:, 0]], end[runs[:, 1] - 1]], 1).ravel().tolist()
                    for part, v in zip(parts, (int(first[i + 1] - first[i]), hit, sorted(set(own["items"])), flat,
                                               without(raw[a:z], flat) if flat else None)):
                        part.append(v)
            arrays = [pa.array(p, k) for p, (_, k) in zip(parts, C.arrow_schema(fields))]
            made = pa.StructArray.from_arrays(arrays, names=[f for f, _ in fields])
            names = [c for c in batch.schema.names if c != hits]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], names=[*names, leak])

    return joined.mapInArrow(unite, schema), leak


def contaminated(leak):
    """At least a twentieth of the words hit."""
    return (leak["n_hit"] > 0) & (20 * leak["n_hit"] >= leak["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; in the others the removal spans are cut out."""
    found, leak = find(docs, benchmark, cut=True)
    kept = found.where(~contaminated(F.col(leak)))
    text = F.coalesce(F.col(f"{leak}.rest"), F.col("text"))
    return kept.select(*[(text if c == "text" else F.when(F.col(f"{leak}.n_hit") > 0, F.length(text).cast(t)).otherwise(F.col(c)) if c == "n_chars" else F.col(c)).alias(c)
                         for c, t in docs.dtypes])
