"""BIO sequence functions: native Spark column expressions, and Arrow kernels for T04-T06 and T14.

Most are built from higher-order functions (``transform``, ``filter``, ``aggregate``,
``zip_with``); what needs prefix sums over several sequences runs as columnar kernels
(``kernels``).  Either way a row's sequence work stays inside that row: no shuffle.

Whole texts can be long (10^5 characters), so every per-character function here is
**linear** in the sequence length.  Immutable Spark arrays make an ``aggregate`` that
appends to an array quadratic, so prefix sums and "which run owns position p" are built
with run-length owner arrays instead:

* ``owner = flatten(transform(lengths, (l, k) -> array_repeat(k, l)))`` maps each
  position to its run in one pass;
* run starts are the positions where the owner changes.

Functions that index an array inside a lambda take that array as a *column reference*
(materialised with ``withColumn`` first) and reference it once more outside the lambda
(``_pinned``), so Catalyst's CollapseProject keeps it computed once per row instead of
inlining it into the per-element lambda.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.constants import ALL_LABELS, EOS_ID, MAX_SEQ_LEN, PAD_ID, SOS_ID
from tagloom.functions import kernels

UNK = "[UNK]"
WINDOW = MAX_SEQ_LEN - 2          # positions of one fixed-length window without its frame

_STR_ARRAY = "array<string>"
_INT_ARRAY = "array<int>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_strings() -> Column:
    return F.expr(f"cast(array() as {_STR_ARRAY})")


def empty_ints() -> Column:
    return F.expr(f"cast(array() as {_INT_ARRAY})")


def positions(arr) -> Column:
    """1..size(arr) (empty for an empty array; ``sequence(1, 0)`` would count down)."""
    n = F.size(_c(arr))
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(empty_ints())


def _pinned(arr, expr: Column) -> Column:
    """``expr`` that also references ``arr`` outside its lambdas (see module doc)."""
    return F.when(F.size(_c(arr)) >= 0, expr)


# ----------------------------------------------------------------------------------
# Single-pass element-wise functions
# ----------------------------------------------------------------------------------
def bio_split(bio) -> Column:
    """Blank-separated label string -> label array (whitespace runs split once)."""
    s = F.trim(_c(bio))
    return F.when(s == "", empty_strings()).otherwise(F.split(s, r"\s+"))


def chars(text) -> Column:
    """Characters (code points) of a string; the empty string has none."""
    t = _c(text)
    return F.when(t == "", empty_strings()).otherwise(F.split(t, ""))


def _label_map() -> Column:
    return F.create_map(*[x for i, name in enumerate(ALL_LABELS) for x in (F.lit(name), F.lit(i))])


def label_encode(labels) -> Column:
    """Label names -> ids; an unknown label fails the job."""
    m = _label_map()
    return F.transform(_c(labels), lambda x: F.coalesce(
        F.element_at(m, x), F.raise_error(F.concat(F.lit("unknown label: "), x)).cast("int")))


def label_decode(ids) -> Column:
    """Label ids -> names; an id outside the dictionary fails the job (ANSI)."""
    names = F.array(*[F.lit(n) for n in ALL_LABELS])
    return F.transform(_c(ids), lambda i: F.element_at(names, i + 1))


def char_labels(text, labels) -> Column:
    """Pair characters with labels, truncated to the shorter side (like ``zip``)."""
    z = F.arrays_zip(chars(text).alias("ch"), _c(labels).alias("label"))
    return F.filter(z, lambda p: p["ch"].isNotNull() & p["label"].isNotNull())


def mark_text(text, labels) -> Column:
    """Prepend every non-``O`` label name to its character and join."""
    return F.array_join(F.transform(char_labels(text, labels), lambda p: F.concat(
        F.when(p["label"] == "O", F.lit("")).otherwise(p["label"]), p["ch"])), "")


def strip_blank_labels(text, labels) -> Column:
    """Drop the labels that sit on an ASCII blank (U+0020 only)."""
    return F.transform(F.filter(char_labels(text, labels), lambda p: p["ch"] != " "),
                       lambda p: p["label"])


def bio_inner(label) -> Column:
    """``B-X`` -> ``I-X``; anything else unchanged."""
    return F.regexp_replace(_c(label), "^B", "I")


def join_labels(labels, null_as: str | None = None) -> Column:
    """Labels -> one blank-separated string."""
    return F.array_join(_c(labels), " ", null_as) if null_as else F.array_join(_c(labels), " ")


# ----------------------------------------------------------------------------------
# run-length helpers (linear prefix sums)
# ----------------------------------------------------------------------------------
def owner(lengths) -> Column:
    """Position -> 1-based run index, for runs of the given (non-negative) lengths."""
    return F.flatten(F.transform(_c(lengths), lambda l, k: F.array_repeat(k + 1, l)))


def exclusive_prefix(lengths) -> Column:
    """Exclusive prefix sums of an int array, linear.

    Every run gets one marker slot before its ``l`` slots, so zero-length runs keep a
    start; the marker of run k (0-based) sits at slot ``sum(l_i + 1 for i < k) + 1``.
    The owner array is compared with its shifted copy through ``arrays_zip`` so the
    expression is evaluated once.
    """
    own = F.flatten(F.transform(_c(lengths), lambda l, k: F.array_repeat(k, l + 1)))
    shifted = F.concat(F.array(F.lit(-1)), own)
    z = F.arrays_zip(own.alias("o"), shifted.alias("prev"))
    slots = F.transform(z, lambda e, p: F.struct((p + 1).alias("p"), e["o"].alias("o"),
                                                 e["prev"].alias("prev")))
    starts = F.filter(slots, lambda e: e["o"].isNotNull() & (e["o"] != e["prev"]))
    return F.transform(starts, lambda e, k: e["p"] - 1 - k)


# ----------------------------------------------------------------------------------
# tokens
# ----------------------------------------------------------------------------------
def token_text(token) -> Column:
    """A token's characters: a leading ``##`` marks a continuation piece."""
    return F.regexp_replace(_c(token), "^##", "")


def token_len(token) -> Column:
    """Characters a token covers; ``[UNK]`` covers one."""
    t = _c(token)
    return F.when(t == UNK, F.lit(1)).otherwise(F.length(token_text(t)))


def _columnar(kernel, returns: str = _STR_ARRAY):
    """An Arrow function of a kernel; a row with any null input is null."""
    @F.arrow_udf(returns)
    def run(*columns: pa.Array) -> pa.Array:
        return kernels.by_slices(kernel, *columns)
    return run


def with_aligned(df: DataFrame, text: str, labels: str, tokens: str, out: str) -> DataFrame:
    """T03 + T04: one label per token."""
    return df.withColumn(out, _columnar(kernels.align)(text, labels, tokens))


def with_expanded(df: DataFrame, tokens: str, token_labels: str, out: str) -> DataFrame:
    """Token labels -> character labels of the token text."""
    return df.withColumn(out, _columnar(kernels.expand)(tokens, token_labels))


def with_realigned(df: DataFrame, text: str, tokens: str, char_labels: str, out: str) -> DataFrame:
    """The token-text labels back on the original characters."""
    return df.withColumn(out, _columnar(kernels.realign)(text, tokens, char_labels))


# ----------------------------------------------------------------------------------
# Fixed-length frames
# ----------------------------------------------------------------------------------
def frame_pad(ids, length: int = MAX_SEQ_LEN) -> Column:
    """``[SOS] + ids + [EOS] + [PAD]*`` to a fixed length (ids must fit)."""
    x = _c(ids)
    return F.concat(F.array(F.lit(SOS_ID)), x, F.array(F.lit(EOS_ID)),
                    F.array_repeat(F.lit(PAD_ID), F.lit(length - 2) - F.size(x)))


def windows(arr_ref, size: int = WINDOW) -> Column:
    """Consecutive windows of ``size`` elements covering the whole array (>= 1 window)."""
    a = _c(arr_ref)
    nw = F.greatest(F.lit(1), F.ceil(F.size(a) / F.lit(size)).cast("int"))
    return _pinned(a, F.transform(F.sequence(F.lit(0), nw - 1),
                                  lambda w: F.slice(a, w * size + 1, size)))


def strip_frame(ids) -> Column:
    """Drop pad ids, then the first and the last (frame) position."""
    kept = F.filter(_c(ids), lambda i: i != PAD_ID)
    return F.slice(kept, 2, F.greatest(F.size(kept) - 2, F.lit(0)))


def mask_positions(labels, mask) -> Column:
    """Label ids where ``label != [PAD]`` and the attention mask is set."""
    z = F.arrays_zip(_c(labels).alias("l"), _c(mask).alias("m"))
    return F.transform(F.filter(z, lambda p: (p["l"] != PAD_ID) & (p["m"] == 1)), lambda p: p["l"])


def normalise_text(s) -> Column:
    """Drop whitespace, ``[UNK]`` -> ``ø``, lower-case."""
    return F.lower(F.replace(F.regexp_replace(_c(s), r"\s+", ""), F.lit(UNK), F.lit("ø")))


# ----------------------------------------------------------------------------------
# spans
# ----------------------------------------------------------------------------------
def with_spans(df: DataFrame, labels: str, out: str) -> DataFrame:
    """Labels -> array<struct<start,end,kind>>, linear."""
    return df.withColumn(out, _columnar(kernels.spans, "array<struct<start:int,end:int,kind:string>>")(labels))


def explode_rows(df: DataFrame, arr, alias: str, keep: list[str], pos: str | None = None) -> DataFrame:
    """Explode a computed array into rows.

    ``explode`` makes Catalyst infer ``size(arr) > 0`` and push it below joins and
    projections, which inlines the whole (expensive) array expression into a filter;
    ``explode_outer`` plus a null filter above the generator keeps it computed once.
    """
    if pos:
        out = df.select(*keep, F.posexplode_outer(_c(arr)).alias(pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(_c(arr)).alias(alias))
    return out.filter(F.col(alias).isNotNull())
