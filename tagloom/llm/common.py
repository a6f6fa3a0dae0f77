"""Helpers shared by the operators: whole-text array work inside Arrow batches and bounded samples.

Texts are handled as the UTF-8 bytes of an Arrow column.  A batch is cut into slices of a
few megabytes (one text is never cut, so a slice is as long as its longest text) and every
step is a numpy pass over the slice, so memory is bounded by the slice and not by the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
WHITESPACE = b" \t\n\x0b\x0c\r"
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow columns -----------------------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, about ``target`` bytes each."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + target, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def lut(members: bytes | range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte, word, ...) between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def runs(cls: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of one non-zero class; a run never crosses a text edge."""
    n = len(cls)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:n])
    edge[offs] = True
    at = np.flatnonzero(edge)
    keep = cls[at[:-1]] != 0
    return at[:-1][keep], at[1:][keep]


def gather(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Positions of the concatenated spans (start, size), or of those that ``which`` names."""
    if which is not None:
        starts, sizes = starts[which], sizes[which]
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def same_bytes(data: np.ndarray, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray,
               other: np.ndarray | None = None) -> bool:
    """Whether the spans of ``data`` equal their counterparts (in ``other``, if given)."""
    other = data if other is None else other
    return bool(((e1 - s1) == (e2 - s2)).all()) and bool((data[gather(s1, e1 - s1)] == other[gather(s2, e2 - s2)]).all())


# --- hashes ------------------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE_CODE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_MULT))


class _Cache(dict):
    """Filled again in every worker; it travels empty."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _MULT), ("down", _MULT_INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


class SpanHash:
    """64-bit hashes of any byte spans of a slice: prefix sums of a polynomial over the bytes."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_CODE[data] * up[:len(data)], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sum[ends] - self._sum[starts]) * self._down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(_MULT))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive items; the caller masks windows across texts."""
    if len(h) < k:
        return np.empty(0, U64)
    n = len(h) - k + 1
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(_MULT) + h[j:j + n]
    return mix(out)


def string_hash(text: bytes) -> int:
    """The hash ``SpanHash`` gives to these bytes."""
    data = np.frombuffer(text, np.uint8)
    return int(SpanHash(data)(np.array([0]), np.array([len(data)]))[0])


# --- first rows -------------------------------------------------------------------------

NO_SCORE = np.int64(-1) << np.int64(62)
NO_ID = np.int64((1 << 63) - 1)       # stands for null: last among equal scores


class Best:
    """The first ``k`` (score descending, id ascending) rows of each slot."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.id = k, np.full((slots, k), NO_SCORE), np.full((slots, k), NO_ID)

    def floor(self) -> np.ndarray:
        """A row must score this to enter a slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        here = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(here, self.k)])
        score = np.concatenate([score, self.score[here].ravel()])
        ids = np.concatenate([ids, self.id[here].ravel()])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.score[slot[keep], rank[keep]] = score[keep]
        self.id[slot[keep], rank[keep]] = ids[keep]


# --- rows in, rows out -------------------------------------------------------------------

def unused(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(fields: list[tuple[str, str]]) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<string>": pa.list_(pa.string())}
    return [(n, kinds[t]) for n, t in fields]


def add_columns(df: DataFrame, text: str, fields: list[tuple[str, str]], make: Callable,
                name: str = "found") -> tuple[DataFrame, str]:
    """``df`` with one more struct column of ``fields`` computed from the column ``text``.

    ``make(bytes, offsets)`` gets a slice of whole texts and returns one list or array per
    field.  All other columns pass through unread, so no key is needed: null and repeated ids
    are no special case.  Returns the frame and the (unused) name of the struct column.
    """
    name = unused(df, name)
    kinds = arrow_schema(fields)
    struct = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([*df.schema.fields, T.StructField(name, struct)])
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            parts: list[list] = [[] for _ in kinds]
            for _, _, data, offs in slices(*utf8(batch.column(at))):
                for part, values, (_, kind) in zip(parts, make(data, offs), kinds):
                    part.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
            arrays = [pa.concat_arrays(p) if p else pa.array([], k) for p, (_, k) in zip(parts, kinds)]
            made = pa.StructArray.from_arrays(arrays, names=[n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema), name


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever other columns the table has."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col, parts: int):
    """crc32 of the id as text, modulo ``parts`` (null id: null)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def held_out(id_col, parts: int, rest: int):
    """Whether the id's fold is ``rest``; a null id has none (and is in no fold to learn from)."""
    return F.coalesce(fold(id_col, parts) == rest, F.lit(False))


def sample_by_class(docs: DataFrame, labels: DataFrame, per_class: int, seed: int = 17,
                    bound: int | None = 64) -> tuple[DataFrame, dict]:
    """A bounded sample of labelled texts: (doc_id, text, label) and the kept share per class.

    ``labels`` is (doc_id, label).  About ``per_class`` ids are kept of each class, by a hash of
    the id against the class's share, so the sample is the same whatever the partitioning.  Ids
    without a label, with a null id or in no document do not count; an id with several labels
    takes the largest; of a repeated id the longest text is taken, of equally long ones the
    last in binary order.  There may be ``bound`` classes; None: the caller has bounded them.
    The sampled ids (``per_class`` x classes, so of proven size) are broadcast and the texts
    are never shuffled before the choice.
    """
    labels = (labels.where("doc_id is not null and label is not null")
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in (sizes if bound is None else sizes.limit(bound + 1)).collect()}
    if bound is not None and len(sizes) > bound:
        raise ValueError(f"more than {bound} classes")
    shares = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    if not shares:
        return docs.join(labels, "doc_id").select("doc_id", "text", "label"), shares
    steps = 1 << 30
    limit = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(int(v * steps)))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(steps)) < limit[F.col("label")]
    chosen = labels.where(drawn)
    sample = (docs.join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"), F.max("label").alias("label")))
    return sample, shares


def train_in_one_task(sample: DataFrame, fit: Callable) -> bytes | None:
    """Run ``fit(pandas frame) -> bytes`` over a bounded sample in one task; None for an empty one.

    The driver gets the finished model, never the texts.
    """
    def run(frames):
        import pandas as pd
        frames = [f for f in frames if len(f)]
        if frames:
            rows = pd.concat(frames, ignore_index=True).sort_values("doc_id", ignore_index=True)
            yield pd.DataFrame({"model": [fit(rows)]})

    got = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else None
