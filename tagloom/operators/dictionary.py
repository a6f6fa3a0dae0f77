"""One dictionary for a corpus, shipped to its rows block by block.

The distinct keys of a table are joined with whatever is known of them once; the rows are cut into
blocks of a few megabytes of text, and each block gets the entries of its own distinct keys.  A hot
key so occurs once per block, not once per row, and the rows are shuffled once however many
tables the dictionary was joined with.  Nothing is broadcast and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from tagloom.session import materialize

BLOCK = "__block"
BLOCK_BYTES = 2 << 20
LONG = [1 << 13, 1 << 16]       # bytes from which a text is in the next length class
ROW_BYTES = 64                  # counted for each row besides its text, so that a block has a bounded number of rows


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of strings; none for a null."""
    if pa.types.is_list(column.type):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        reach = np.concatenate([[0], np.cumsum(row_bytes(column.flatten()))])
        end = np.cumsum(n)
        return reach[end] - reach[end - n]
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def in_blocks(df: DataFrame, text: str, size: int = BLOCK_BYTES) -> DataFrame:
    """``df`` plus ``__block``: rows of a task share a block of about ``size`` bytes of text (a string or a list of them).

    Rows of one length class (``LONG``) are numbered on, so a few long texts do not hold up blocks of
    short ones.  A row is in the block in which its text begins, so a block holds less than ``size`` bytes
    and one text.  The rows are written, which keeps the numbers if a task is repeated.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 33, [0] * (len(LONG) + 1)
        for batch in batches:
            if batch.num_rows:
                n = row_bytes(batch.column(text)) + ROW_BYTES
                kind, block = np.searchsorted(LONG, n, "right"), np.empty(len(n), np.int64)
                for k in np.unique(kind).tolist():
                    own = kind == k
                    end = seen[k] + np.cumsum(n[own])
                    block[own] = first + (k << 31) + (end - n[own]) // size
                    seen[k] = int(end[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, BLOCK])

    schema = StructType([*df.schema.fields]).add(BLOCK, LongType())
    return materialize(df.mapInArrow(number, schema), "blocks", bounded=True)


def block_keys(rows: DataFrame, column: str, key: str, find: Callable[[pa.Array], pa.Array] = lambda lists: lists.flatten()) -> DataFrame:
    """(__block, key): the distinct keys of every block; null keys take no part.  Written once.

    ``column`` is a list of keys, or texts in which ``find`` finds them.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(BLOCK).to_numpy()
            order = np.argsort(block, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order)) if len(order) else []
            lo = 0
            for hi in ends:
                own = batch.column(column).take(pa.array(order[lo:hi]))
                found = find(own).unique().drop_null().cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block[order[lo]])), found], names=[BLOCK, key])
                lo = hi

    each = rows.select(BLOCK, column).mapInArrow(keys, f"{BLOCK} long, {key} string")
    return materialize(each.distinct(), "block_keys", bounded=True)


def per_block(rows: DataFrame, used: DataFrame, dictionary: DataFrame, key: str,
              work: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``work(rows, entries)`` for every block, with the dictionary's entries of the block's keys.

    ``used`` is what ``block_keys`` gave; a key without an entry is left out, and a block without any
    gets an empty table.
    """
    entries = used.join(dictionary, key)
    return rows.groupBy(BLOCK).cogroup(entries.groupBy(BLOCK)).applyInArrow(work, schema)
