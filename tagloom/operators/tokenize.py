"""Vocabulary mining (T10/A07), the vocabulary table (S06) and corpus tokenization.

Tokenizer contract (a table job):

* pieces are maximal ASCII-letter runs, digit runs, or any other single non-blank
  character; the ASCII blank U+0020 separates pieces and is dropped;
* a letter run found in the vocabulary table is one token; an unknown run of two or
  more letters becomes a head piece plus one ``##`` continuation piece;
* other whitespace characters (tab, newline, ...) become ``[UNK]``;
* the whole text is tokenized; fixed-length encodings are cut into consecutive
  windows of ``MAX_SEQ_LEN - 2`` tokens (see ``encode_windows``), so no text is cut.

The distinct pieces of the corpus make one dictionary (``operators.dictionary``): vocabulary, token
ids, emission and mood vectors are joined to it, and each block of texts is cut with the entries of
its own pieces.  So a text is shuffled once, whatever is computed of its tokens.  Token ids: ``[PAD]`` 0, ``[UNK]`` 100, ``[CLS]`` 101, ``[SEP]`` 102; a one-character
token gets ``1000 + code point``; a longer one ``2000000`` plus its rank among the corpus's
longer tokens, so an id names one token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.constants import MAX_SEQ_LEN, added_vocab
from tagloom.functions import kernels
from tagloom.operators import dictionary as dy
from tagloom.operators import sampling as sp
from tagloom.operators.dictionary import row_bytes
from tagloom.operators.lookup import attach
from tagloom.session import materialize

# blank-joined words; possessive, so that Java's matcher does not recurse on long texts
LATIN_RUN_RE = r"[A-Za-z]++(?: [A-Za-z]++)*+"
OTHER_BLANKS = "\t\n\x0b\f\r"
PAD_TOKEN_ID, UNK_TOKEN_ID, CLS_TOKEN_ID, SEP_TOKEN_ID = 0, 100, 101, 102
FIRST_LONG_ID = 2000000


def mined_words(reviews: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct blank-split words of the Latin runs of a corpus -> (word)."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, row_bytes(batch.column(0))):
                found = kernels.pieces(part.column(0))[0].unique().cast(pa.string())
                yield pa.RecordBatch.from_arrays([found.filter(pc.match_substring_regex(found, "^[A-Za-z]"))], names=["word"])

    return reviews.select(text_col).mapInArrow(words, "word string").distinct()


def latin_run_trace(reviews: DataFrame) -> DataFrame:
    """T10 trace: every blank-joined Latin run of a row with its label slice (id, k, run, labels).

    A run's label slice is read from the character labels at the run's offset, so a
    slice may start with ``I-`` (mention began earlier) or change inside the run.
    """
    pattern = re.compile(r"[A-Za-z]+(?: [A-Za-z]+)*")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, row_bytes(batch.column("text")) + row_bytes(batch.column("BIO_anno"))):
                ids, row, k, run, labels = part.column("id"), [], [], [], []
                for i, (t, lab) in enumerate(zip(part.column("text").to_pylist(), part.column("BIO_anno").to_pylist())):
                    if t is None:
                        continue
                    lab = lab.split()
                    for j, m in enumerate(pattern.finditer(t)):
                        row.append(i)
                        k.append(j)
                        run.append(m[0])
                        labels.append(" ".join(lab[m.start():m.end()]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(k, pa.int64()), pa.array(run, pa.string()),
                                                  pa.array(labels, pa.string())], names=["id", "k", "run", "labels"])

    schema = StructType([reviews.schema["id"], *StructType.fromDDL("k long, run string, labels string").fields])
    return reviews.select("id", "text", "BIO_anno").mapInArrow(runs, schema)


def slices(batch: pa.RecordBatch, size: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive whole rows of ``batch`` with about ``most`` in all of ``size``, or one row."""
    reach, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fixed_vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in added_vocab()], "word string")


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """A file with one entry per line -> (word) with surrounding blanks stripped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter(F.col("word") != "")


def vocabulary(spark: SparkSession, reviews: DataFrame) -> DataFrame:
    """Tokenizer vocabulary: the fixed added words plus the words mined from ``reviews``."""
    fixed = F.explode(F.split(F.col("word"), " ")).alias("word")
    return fixed_vocab(spark).select(fixed).unionByName(mined_words(reviews)).distinct()


@dataclass
class TokenColumn:
    """A column computed from the tokens of a text.

    ``table`` maps the dictionary's tokens (token) to rows (token, ``value``); ``of(values, tokens, offsets)``
    gives the column for a block: ``values`` of the block's entries (null: not in the table), the entry of
    every position, and the offsets of the texts among the positions.
    """

    name: str
    type: str
    table: Callable[[DataFrame], DataFrame]
    value: str
    of: Callable[[pa.Array, np.ndarray, np.ndarray], pa.Array]


@dataclass
class RowColumn:
    """A column computed from other columns of the block, those of the rows or made before it.

    ``kernel`` (of ``functions.kernels``) works on slices of whole rows; a row with any null input is null.
    """

    name: str
    type: str
    inputs: tuple[str, ...]
    kernel: Callable[..., pa.Array]


def dictionary(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """(piece, pos, token): the tokens of every piece (piece) under the vocabulary (word)."""
    known = vocab.select(F.col("word").alias("piece"), F.lit(True).alias("known")).distinct()
    p = F.col("piece")
    unknown = F.col("known").isNull() & (F.length(p) > 1) & p.rlike("^[A-Za-z]")
    tokens = (F.when(unknown, F.array(F.substring(p, 1, 1), F.concat(F.lit("##"), F.expr("substring(piece, 2)"))))
              .otherwise(F.array(F.when(p.isin(*OTHER_BLANKS), F.lit("[UNK]")).otherwise(p))))
    return pieces.join(known, "piece", "left").select("piece", F.posexplode(tokens).alias("pos", "token"))


def one(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def cut(texts: pa.Array, pieces: pa.Array, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary entry of every token of the texts, and the offsets of the texts among them.

    ``pieces`` and ``pos`` are the entries in the order (piece, pos).
    """
    first = np.flatnonzero(pos == 0)
    per_piece = np.diff(np.append(first, len(pos)))
    found, at = kernels.pieces(texts)
    kinds, distinct = kernels.encoded(found)
    number = pc.index_in(distinct.cast(pa.string()), value_set=pieces.take(pa.array(first)))
    if number.null_count:
        raise KeyError(distinct.filter(number.is_null())[0].as_py())
    code = number.to_numpy(zero_copy_only=False).astype(np.int64)[kinds]
    n = per_piece[code]
    end = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return np.repeat(first[code] - end[:-1], n) + np.arange(end[-1]), end[at]


def tokenize(df: DataFrame, vocab: DataFrame, text_col: str = "text", more: tuple[TokenColumn, ...] | list = (),
             block_bytes: int = dy.BLOCK_BYTES, then: tuple[RowColumn, ...] | list = (), keep: list[str] | None = None) -> DataFrame:
    """Add ``tokens`` (array<string>, the whole text; null text: null), ``more`` and ``then`` to every row of ``df``.

    The rows are written once and shuffled once; ``then`` is computed where the tokens are made, so that
    sequences of tokens and characters leave a block only if the columns to ``keep`` (null: all) have them.
    A column of ``more`` is null where the text is.  Repeated and null ids are rows like others.
    """
    rows = dy.in_blocks(df, text_col, block_bytes)
    used = dy.block_keys(rows, text_col, "piece", lambda texts: kernels.pieces(texts)[0])
    entries = dictionary(used.select("piece").distinct(), vocab)
    if more:
        entries = materialize(entries, "dictionary")
    plain = entries
    for i, m in enumerate(more):
        table = m.table(plain.select("token").distinct()).select("token", F.col(m.value).alias(f"value{i}"))
        entries = entries.join(table, "token", "left")
    work, steps = [(m.name, m.of) for m in more], [(c.name, c.inputs, c.kernel) for c in then]
    added = StructType.fromDDL(", ".join(["tokens array<string>", *[f"`{m.name}` {m.type}" for m in [*more, *then]]]))
    fields = {f.name: f for f in [*df.schema.fields, *added.fields]}
    names = list(fields) if keep is None else keep

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("piece", "ascending"), ("pos", "ascending")]))
        text = left.column(text_col)
        entry, offsets = cut(one(text), one(right.column("piece")), right.column("pos").to_numpy())
        null = pa.array(text.is_null().to_numpy())
        token = pa.DictionaryArray.from_arrays(pa.array(entry, pa.int32()), one(right.column("token")))
        made = {c: left.column(c) for c in left.column_names}
        made["tokens"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), token, mask=null)
        for i, (name, of) in enumerate(work):
            column = of(one(right.column(f"value{i}")), entry, offsets)
            made[name] = pc.if_else(null, pa.scalar(None, column.type), column) if null.true_count else column
        for name, inputs, kernel in steps:
            made[name] = kernels.by_slices(kernel, *[made[c] for c in inputs])
        if "tokens" in names:
            made["tokens"] = kernels.spelled(made["tokens"])
        return pa.Table.from_arrays([made[c] for c in names], names=names)

    return dy.per_block(rows, used, entries, "piece", block, StructType([fields[c] for c in names]))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of values for every text."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def token_numbers(tokens: DataFrame) -> DataFrame:
    """(token, tid) of distinct tokens (token); the longer ones are numbered by rank."""
    long = tokens.where((F.length("token") > 1) & (F.col("token") != "[UNK]"))
    ranked = sp.dense_rank_by_hash(long.withColumn("__h", F.md5("token")), "__h", "token", out="rank")
    short = tokens.where((F.length("token") == 1) | (F.col("token") == "[UNK]"))
    short_id = F.when(F.col("token") == "[UNK]", F.lit(UNK_TOKEN_ID)).otherwise(F.lit(1000) + F.ascii("token"))
    return ranked.select("token", (F.col("rank") + FIRST_LONG_ID).alias("tid")).unionByName(
        short.select("token", short_id.cast("long").alias("tid")))


def id_column(name: str = "ids") -> TokenColumn:
    """T09 while tokenizing: the token ids of each text."""
    return TokenColumn(name, "array<long>", token_numbers, "tid",
                       lambda tid, entry, offsets: lists(tid.to_numpy(zero_copy_only=False)[entry], offsets, pa.int64()))


def token_ids(tokenized: DataFrame) -> DataFrame:
    """Add ``ids`` to rows that have ``tokens`` already (null: null)."""
    distinct = tokenized.select(F.explode_outer(F.array_distinct("tokens")).alias("token")).where(F.col("token").isNotNull()).distinct()

    @F.pandas_udf("array<long>")
    def ids(tokens: pd.Series, hits: pd.Series) -> pd.Series:
        of = [{} if h is None else {x["token"]: x["tid"] for x in h} for h in hits]
        return pd.Series([None if row is None else [found[t] for t in row] for row, found in zip(tokens, of)])

    found = attach(tokenized, F.col("tokens"), token_numbers(distinct), "token", ["tid"], "__ids")
    return found.withColumn("ids", ids("tokens", "__ids")).drop("__ids")


def encode_windows(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """One row per window of ``MAX_SEQ_LEN - 2`` positions: (key, win, win_<column>...)."""
    from tagloom.functions import bio
    n = F.greatest(F.lit(1), F.ceil(F.size(columns[0]) / bio.WINDOW).cast("int"))
    rows = df.select(key, *columns, F.explode(F.sequence(F.lit(0), n - 1)).alias("win"))
    return rows.select(key, F.col("win").cast("long").alias("win"),
                       *[F.slice(c, F.col("win") * bio.WINDOW + 1, F.lit(bio.WINDOW)).alias(f"win_{c}") for c in columns])


def attention_mask(n, length: int = MAX_SEQ_LEN):
    """1 for ``n`` tokens and their frame, 0 for padding."""
    return F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), F.lit(length - 2) - n))


def encode(ids, length: int = MAX_SEQ_LEN):
    """Fixed-length encoding of one window of token ids: input_ids, attention_mask, token_type_ids."""
    framed = F.concat(F.array(F.lit(CLS_TOKEN_ID).cast("long")), ids, F.array(F.lit(SEP_TOKEN_ID).cast("long")))
    pad = F.array_repeat(F.lit(PAD_TOKEN_ID).cast("long"), F.lit(length) - F.size(framed))
    return F.concat(framed, pad), attention_mask(F.size(ids), length), F.array_repeat(F.lit(0), F.lit(length))
