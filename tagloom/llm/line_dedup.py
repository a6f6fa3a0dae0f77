"""Line dedup by a log-template tree of fixed depth.

A line's tokens (split on blanks) have tokens with a digit masked as variable fields, if at least
``SIMILAR`` of the tokens are others.  The tree routes a line by its token count, then by its leading ``DEPTH`` tokens; in a leaf, lines of which at
least ``SIMILAR`` of the tokens agree position by position form one template, whose other
positions are variable.  A template that occurs in ``min_docs`` documents recurs; its lines stay in
the document with the least doc_id and are dropped from all others.

A leaf's lines have an order (most documents first), and each joins the first template that is near
enough, or opens one.  Leaves with more than ``MAX_LEAF`` different lines get the same templates in
rounds: the first ``MAX_LEAF`` lines left are worked through in one task, and the templates that they
open are compared with all other lines of the leaf in as many tasks as it has pieces.  Lines of such a
leaf that share no block of positions with another one are near to none: they are templates of their
own from the start, so that only lines with possible neighbours take rounds.

A line is known by its leaf and a 64-bit hash, so different lines are only mixed up if they share the
leaf and the hash; the token count is part of the leaf as a number.

Three passes over the texts: leaves with their document counts (combined in each batch before they
are shuffled); the lines of recurring leaves, found with a bitmap of eight bits or more a leaf (a
wrong hit only costs a little work; beyond ``MAX_BITMAP_BITS`` a join removes them); the final cut of the documents that lose lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.session import materialize

DEPTH = 3
SIMILAR = 0.7
MAX_LEAF = 1 << 15              # lines of a leaf that one task works through
STEP = 2048                     # of these, compared with one another directly
PAIRS = 1 << 22                 # tokens compared at once
FLUSH = 1 << 13                 # lines that a task gathers before it works through their leaves
BITMAP_BITS = 23                # least size of the bitmap, as a power of two
MAX_BITMAP_BITS = 28            # 32 MB; above, the leaves are also joined

_SPACE = C.lut(C.WHITESPACE)
_DIGIT = C.lut(range(0x30, 0x3A))


class Lines:
    """The lines of a slice: byte spans, text, token count, leaf keys, line key, token hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, min_tokens: int = 1):
        feed = data == 0x0A
        word = ~_SPACE[data]
        # a class change at every line feed and blank; tokens never hold a feed (it is a blank)
        starts, ends = C.runs(word.view(np.int8), offs)
        digit = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_DIGIT[data], out=digit[1:])
        h = C.SpanHash(data)(starts, ends)
        # line edges: text offsets and the byte after every feed
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        edge[1:][feed] = True
        self.start = np.flatnonzero(edge[:-1])
        first = np.searchsorted(starts, np.append(self.start, len(data)))
        count = np.diff(first)
        # tokens with a digit are variable fields, unless too little would be left of the line
        field = digit[ends] > digit[starts]
        fields = C.per_text(field, first)
        h[field & np.repeat(fields <= (1 - SIMILAR) * count, count)] = 0
        self.text = np.searchsorted(offs, self.start, "right") - 1
        self.n_texts = len(offs) - 1
        keep = count >= max(1, min_tokens)
        self.line = np.flatnonzero(keep)                        # lines that take part
        self.first, self.count, self.hashes = first[:-1][keep], count[keep], h
        self.owner = self.text[keep]
        up = np.cumprod(np.full(len(h) + 1, 0x9E3779B97F4A7C15, C.U64), dtype=C.U64)
        down = np.cumprod(np.full(len(h) + 1, C._MULT_INV, C.U64), dtype=C.U64)
        self._sum = np.zeros(len(h) + 1, C.U64)
        np.cumsum((h + C.U64(1)) * up[:len(h)], out=self._sum[1:])
        self._down = down

    def leaf(self) -> np.ndarray:
        """Token count (12 bits, the last value for all above) and hash of the leading tokens (52 bits)."""
        return (np.minimum(self.count, 4095).astype(C.U64) << C.U64(52)) | (self.key(DEPTH) >> C.U64(12))

    def key(self, tokens: int | None) -> np.ndarray:
        """Hash of a line's token count and its first ``tokens`` tokens (None: of all)."""
        n = self.count if tokens is None else np.minimum(self.count, tokens)
        h = (self._sum[self.first + n] - self._sum[self.first]) * self._down[self.first]
        return C.mix(C.mix(h) + self.count.astype(C.U64) * C.U64(0xD6E8FEB86659FD93))


def slot(leaf: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return (leaf & C.U64(64 * len(bitmap) - 1)).astype(np.int64)


def recurring_leaves(docs: DataFrame, min_docs: int, min_tokens: int = 1) -> tuple[np.ndarray, DataFrame | None]:
    """Bitmap (words of bits) of the leaves that occur in ``min_docs`` texts or more; the leaves, if it is too small."""
    def run(batches):
        for batch in batches:
            found = []
            for _, _, data, offs in C.slices(*C.utf8(batch.column(0))):
                lines = Lines(data, offs, min_tokens)
                leaf = lines.leaf()
                pair = np.unique(np.stack([lines.owner.astype(C.U64), leaf], 1), axis=0) if len(leaf) else np.empty((0, 2), C.U64)
                found.append(pair[:, 1])
            leaf, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, C.U64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(n, pa.int64())], names=["leaf", "n"])

    seen = docs.select("text").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    seen = materialize(seen.where(F.col("n") >= min_docs).select("leaf"), "line-leaves")
    wanted = max(BITMAP_BITS, (8 * seen.count()).bit_length())
    bits = min(wanted, MAX_BITMAP_BITS)
    place = F.col("leaf").bitwiseAND(F.lit((1 << bits) - 1))
    words = (seen.select(place.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out, seen if wanted > bits else None


def candidate_lines(docs: DataFrame, bitmap: np.ndarray, leaves: DataFrame | None = None, min_tokens: int = 1) -> DataFrame:
    """(doc_id, leaf, line, tokens): each different line of a document in the bitmap's leaves (and in ``leaves``).

    ``tokens`` packs the line's token hashes (4 bytes each, 0 for a variable field).
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, offs in C.slices(*C.utf8(batch.column(1))):
                lines = Lines(data, offs, min_tokens)
                leaf, bits = lines.leaf(), shared.value
                at = slot(leaf, bits)
                here = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
                line = lines.key(None)
                _, one = np.unique(np.stack([lines.owner[here].astype(C.U64), line[here]], 1), axis=0, return_index=True) if len(here) else (0, here)
                here = here[one]
                small = (lines.hashes >> C.U64(32)).astype(np.uint32) | (lines.hashes != 0).astype(np.uint32)
                tokens = [small[a:a + n].tobytes() for a, n in zip(lines.first[here].tolist(), lines.count[here].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lines.owner[here] + lo)), pa.array(leaf[here].view(np.int64)),
                     pa.array(line[here].view(np.int64)), pa.array(tokens, pa.binary())],
                    names=["doc_id", "leaf", "line", "tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, leaf long, line long, tokens binary")
    return out if leaves is None else out.join(leaves, "leaf", "left_semi")


def near(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows agree with the other line in enough positions."""
    return (rows == others).mean(1) >= SIMILAR


def block_columns(n: int) -> Iterator[np.ndarray]:
    """Position sets; near lines of ``n`` tokens agree in every position of at least one of them.

    With at most ``m`` unequal positions, one of ``m + 1`` disjoint blocks is untouched, and two of ``m + 2``.
    The leading tokens, equal in a leaf, are left out.
    """
    m = n - int(np.argmax(np.arange(n + 1) / n >= SIMILAR))
    free = np.arange(DEPTH if n > DEPTH else 0, n)
    pick = 2 if m <= 8 and len(free) >= m + 2 else 1
    for blocks in combinations(np.array_split(free, m + pick), pick):
        yield np.concatenate(blocks)


def block_key(tokens: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Hash of the tokens in some positions."""
    h = np.zeros(len(tokens), C.U64)
    for c in columns.tolist():
        h = C.mix(h + tokens[:, c].astype(C.U64) + C.U64(c + 1))
    return h


def first_near(rows: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The first of ``leads`` that each row is near to, or -1; only pairs with an equal block are compared."""
    none = len(leads)
    out = np.full(len(rows), none)
    if not none or not len(rows):
        return np.full(len(rows), -1)

    for columns in block_columns(rows.shape[1]):
        lead = block_key(leads, columns)
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        mine = block_key(rows, columns)
        lo = np.searchsorted(lead, mine, "left")
        total = np.concatenate([[0], np.cumsum(np.searchsorted(lead, mine, "right") - lo)])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, total[a] + max(1, PAIRS // rows.shape[1]), "right")) - 1)
            count = np.diff(total[a:b + 1])
            row = np.repeat(np.arange(a, b), count)
            other = order[np.arange(total[a], total[b]) - np.repeat(total[a:b], count) + np.repeat(lo[a:b], count)]
            better = other < out[row]
            row, other = row[better], other[better]
            same = near(rows[row], leads[other])
            np.minimum.at(out, row[same], other[same])
            a = b
    return np.where(out == none, -1, out)


def template_of(tokens: np.ndarray) -> np.ndarray:
    """Row of each line's template in one leaf: the first line, in order, that is similar enough."""
    out = np.arange(len(tokens))
    leads = np.empty(0, np.int64)
    for lo in range(0, len(tokens), STEP):
        left = np.arange(lo, min(len(tokens), lo + STEP))
        at = first_near(tokens[left], tokens[leads])
        out[left[at >= 0]] = leads[at[at >= 0]]
        left, new = left[at < 0], []
        while len(left):
            same = near(tokens[left], tokens[left[0]])
            out[left[same]] = left[0]
            new.append(left[0])
            left = left[~same]
        leads = np.concatenate([leads, np.array(new, np.int64)])
    return out


def matrix(tokens: pa.ChunkedArray) -> np.ndarray:
    """Token hashes of lines of one leaf, a row each."""
    data, _ = C.utf8(tokens)
    return np.frombuffer(data.tobytes(), np.uint32).reshape(len(tokens), -1)


def in_pieces(lines: DataFrame) -> DataFrame:
    """``lines`` (leaf, n, line, tokens) plus piece: consecutive lines of a leaf, numbered in its order."""
    def run(batches):
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(0).to_numpy(zero_copy_only=False)
            head = np.append(True, leaf[1:] != leaf[:-1])
            cut = np.flatnonzero(head)
            place = np.arange(len(leaf)) - cut[np.cumsum(head) - 1]
            if leaf[0] == last:
                place[:cut[1] if len(cut) > 1 else len(leaf)] += seen
            last, seen = leaf[-1], int(place[-1]) + 1
            piece = (task << 32) + place // MAX_LEAF
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece, pa.int64())], names=["leaf", "n", "line", "tokens", "piece"])

    order = [F.col("leaf"), F.desc("n"), F.col("line")]
    ordered = lines.select("leaf", "n", "line", "tokens").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "leaf long, n long, line long, tokens binary, piece long")


def open_templates(table: pa.Table) -> pa.Table:
    """The first lines of a leaf with their templates; place is the line's in the order, for those that open one."""
    table = table.sort_by([("n", "descending"), ("line", "ascending")])
    line = table.column("line").to_numpy()
    at = template_of(matrix(table.column("tokens")))
    opens = at == np.arange(len(at))
    tokens = [t if o else None for t, o in zip(table.column("tokens").to_pylist(), opens.tolist())]
    return pa.table({"leaf": table.column("leaf"), "line": line, "template": line[at],
                     "place": pa.array(np.arange(len(at)), pa.int64(), mask=~opens), "tokens": pa.array(tokens, pa.binary())})


def join_templates(rows: pa.Table, leads: pa.Table) -> pa.Table:
    """A piece's lines with the first of the leaf's open templates that each is near to, or null."""
    template = np.zeros(len(rows), np.int64)
    at = np.full(len(rows), -1)
    if len(rows) and len(leads):
        leads = leads.sort_by("place")
        at = first_near(matrix(rows.column("tokens")), matrix(leads.column("tokens")))
        template = leads.column("line").to_numpy()[at]
    return rows.select(["leaf", "n", "line", "tokens", "piece"]).append_column("template", pa.array(template, pa.int64(), mask=at < 0))


def with_neighbours(lines: DataFrame) -> DataFrame:
    """(leaf, line) of the lines that share a block of positions with another line of their leaf.

    All others are near to no line.  The blocks' keys are counted (combined in each task first) and only
    the shared ones are joined back.
    """
    def run(batches):
        for batch in batches:
            tokens = batch.column(2)
            sizes = np.diff(C.utf8(tokens)[1]) // 4
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                rows, mine = matrix(tokens.take(pa.array(at))), [batch.column(k).take(pa.array(at)) for k in (0, 1)]
                for b, columns in enumerate(block_columns(n)):
                    key = C.mix(block_key(rows, columns) + C.U64(b + 1))
                    yield pa.RecordBatch.from_arrays([*mine, pa.array(key.view(np.int64))], names=["leaf", "line", "key"])

    keys = lines.select("leaf", "line", "tokens").mapInArrow(run, "leaf long, line long, key long")
    shared = keys.groupBy("leaf", "key").agg(F.count("*").alias("c")).where("c > 1").select("leaf", "key")
    return keys.join(shared, ["leaf", "key"], "left_semi").select("leaf", "line").distinct()


def templates_by_rounds(lines: DataFrame) -> DataFrame:
    """(leaf, line, template) of large leaves: the templates that one task would find, working through the whole leaf."""
    social = materialize(with_neighbours(lines), "line-neighbours")
    alone = lines.join(social, ["leaf", "line"], "left_anti").select("leaf", "line", F.col("line").alias("template"))
    left, done = materialize(in_pieces(lines.join(social, ["leaf", "line"], "left_semi")), "line-pieces"), [alone]
    before = F.coalesce(F.sum("c").over(Window.partitionBy("leaf").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    while True:
        size = left.groupBy("leaf", "piece").agg(F.count("*").alias("c")).withColumn("before", before)
        first = (F.col("before") == 0) | (F.col("before") + F.col("c") <= MAX_LEAF)
        size = materialize(size.select("leaf", "piece", first.alias("first")), "line-heads")
        if size.isEmpty():
            break
        marked = left.join(size, ["leaf", "piece"])
        head = marked.where("first").drop("first").groupBy("leaf").applyInArrow(
            open_templates, "leaf long, line long, template long, place long, tokens binary")
        head = materialize(head, "line-opened")
        leads = head.where("place is not null").select("leaf", "line", "place", "tokens").join(size.where("not first").select("leaf", "piece"), "leaf")
        rest = marked.where("not first").drop("first").groupBy("leaf", "piece").cogroup(leads.groupBy("leaf", "piece")).applyInArrow(
            join_templates, "leaf long, n long, line long, tokens binary, piece long, template long")
        rest = materialize(rest, "line-rest")
        done += [head.select("leaf", "line", "template"), rest.where("template is not null").select("leaf", "line", "template")]
        left = rest.where("template is null").drop("template")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def templates(lines: DataFrame) -> DataFrame:
    """(leaf, line, template) for the different lines of ``lines``; in its leaf a template is named by its first line."""
    distinct = lines.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    distinct = materialize(distinct, "line-distinct")
    large = materialize(distinct.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") > MAX_LEAF).select("leaf"), "line-large")
    if large.isEmpty():
        return templates_in_tasks(distinct)
    return templates_in_tasks(distinct.join(large, "leaf", "left_anti")).union(templates_by_rounds(distinct.join(large, "leaf", "left_semi")))


def templates_in_tasks(lines: DataFrame) -> DataFrame:
    """(leaf, line, template) of leaves that a task can hold."""
    def run(batches):
        held: list = []

        def flush(upto_last: bool):
            """Work through the whole leaves held; the last one may go on in the next batch."""
            table = pa.Table.from_batches(held)
            leaf = table.column("leaf").combine_chunks().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            end = len(leaf) if upto_last else int(cut[-1])
            line = table.column("line").combine_chunks().to_numpy(zero_copy_only=False)
            data, offs = C.utf8(table.column("tokens"))
            name = line.copy()
            cut = np.append(cut, len(leaf))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if b - a > 1 and b <= end:
                    block = data[offs[a]:offs[b]].view(np.uint8).tobytes()
                    rows = np.frombuffer(block, np.uint32).reshape(b - a, -1)
                    name[a:b] = line[a + template_of(rows)]
            rest = table.slice(end).to_batches() if not upto_last else []
            return pa.RecordBatch.from_arrays([pa.array(leaf[:end]), pa.array(line[:end]), pa.array(name[:end])], names=["leaf", "line", "template"]), rest

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= FLUSH:
                    out, held = flush(False)
                    yield out
        if held:
            yield flush(True)[0]

    ordered = lines.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line").select("leaf", "line", "tokens")
    return ordered.mapInArrow(run, "leaf long, line long, template long")


def drops(docs: DataFrame, min_docs: int = 2, min_tokens: int = 1) -> DataFrame:
    """(doc_id, lines): the keys of the lines that each document loses."""
    lines = materialize(candidate_lines(docs, *recurring_leaves(docs, min_docs, min_tokens), min_tokens), "line-candidates")
    named = materialize(templates(lines), "line-templates")
    at = materialize(lines.where("doc_id is not null").select("doc_id", "leaf", "line").join(named, ["leaf", "line"]), "line-places")
    stats = (at.groupBy("leaf", "template").agg(F.min("doc_id").alias("home"), F.count_distinct("doc_id").alias("docs"))
             .where(F.col("docs") >= min_docs).select("leaf", "template", "home"))
    stats = materialize(stats, "line-stats")                     # a join of two tables: a hot template is split
    return (at.join(stats, ["leaf", "template"]).where("doc_id <> home")
            .groupBy("doc_id").agg(F.collect_set("line").alias("lines")))


def dedup(docs: DataFrame, min_docs: int = 2, report: bool = False, min_tokens: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, any others) without the lines whose templates recur.

    Rows that share a doc_id are one document; rows with a null doc_id stay as they are.  Null and
    empty texts stay; a text may become empty.  Lines of fewer than ``min_tokens`` tokens stay;
    with 1 every line that is not blank takes part, the shorter ones as exact repeats.
    With ``report`` a struct column ``line_report`` (n_lines, n_dropped) is added under an unused
    name, as the last column.
    """
    lost = drops(docs.select("doc_id", "text"), min_docs, min_tokens)
    key, gone = C.unused(docs, "lost_id"), C.unused(docs, "lost_lines")
    lost = lost.select(F.col("doc_id").alias(key), F.col("lines").alias(gone))
    joined = docs.join(lost, docs["doc_id"] == lost[key], "left").drop(key)
    text_at, gone_at, columns = docs.columns.index("text"), len(docs.columns), docs.columns

    def run(batches):
        for batch in batches:
            out, n_lines, n_gone = [], [], []
            text, keys = batch.column(text_at), batch.column(gone_at)
            for lo, hi, data, offs in C.slices(*C.utf8(text)):
                some = [i for i in range(lo, hi) if keys[i].is_valid]
                feeds = C.per_text(data == 0x0A, offs)
                n_lines += (feeds + (np.diff(offs) > 0)).tolist()
                new: dict[int, bytes] = {}
                lose = np.zeros(hi - lo, np.int64)
                if some:
                    lines = Lines(data, offs, min_tokens)
                    line = lines.key(None).view(np.int64)
                    edge = np.append(lines.start, len(data))
                    raw = data.tobytes()
                    at = np.searchsorted(lines.owner, np.arange(hi - lo + 1))
                    every = np.searchsorted(lines.text, np.arange(hi - lo + 1))
                    for i in some:
                        a, b = at[i - lo], at[i - lo + 1]
                        bad = lines.line[a:b][np.isin(line[a:b], keys[i].values.to_numpy(zero_copy_only=False))]
                        mine = np.arange(every[i - lo], every[i - lo + 1])
                        stay = np.setdiff1d(mine, bad)
                        end = offs[i - lo + 1]
                        parts = [raw[edge[k]:min(edge[k + 1], end)] for k in stay.tolist()]
                        rest = b"".join(parts)
                        if len(stay) and len(mine) and stay[-1] != mine[-1] and rest.endswith(b"\n"):
                            rest = rest[:-1]
                        new[i] = rest
                        lose[i - lo] = len(bad)
                n_gone += lose.tolist()
                out += [new[i].decode("utf-8", "replace") if i in new else None for i in range(lo, hi)]
            merged = pc.coalesce(pa.array(out, pa.string()).cast(text.type), text)
            arrays = [merged.cast(c.type) if k == text_at else c for k, c in enumerate(batch.columns[:gone_at])]
            names = list(columns)
            if report:
                arrays.append(pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=["n_lines", "n_dropped"]))
                names.append(report_name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    report_name = C.unused(docs, "line_report")
    from pyspark.sql import types as T
    schema = T.StructType(list(docs.schema.fields))
    if report:
        schema = T.StructType([*schema.fields, T.StructField(report_name, T._parse_datatype_string("n_lines long, n_dropped long"))])
    return joined.mapInArrow(run, schema)
