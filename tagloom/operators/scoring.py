"""Scoring texts with fitted tables: tags (M08), moods (M07) and the submission row of both."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.constants import ALL_LABELS
from tagloom.functions import kernels
from tagloom.operators import models as md
from tagloom.operators import tokenize as tk

SUBMISSION = "id long, BIO_anno string, class int"


@dataclass
class Models:
    """Fitted tables: vocabulary, transitions, emissions, mood counts and priors."""

    vocab: DataFrame
    transitions: DataFrame
    emissions: DataFrame
    mood: DataFrame
    priors: DataFrame


def _annotation(nulls: np.ndarray, text: pa.Array, tokens: pa.Array, path: pa.Array) -> pa.Array:
    """A label-id path of the tokens as the text's annotation."""
    values, at = kernels.flat_list(path)
    labels = kernels.list_column(kernels.named(ALL_LABELS, values.to_numpy(zero_copy_only=False)), np.diff(at), nulls)
    return kernels.joined(nulls, kernels.realign(nulls, text, tokens, kernels.expand(nulls, tokens, labels)))


def tag(docs: DataFrame, vocab: DataFrame, transitions: DataFrame, emissions: DataFrame, more: tuple = (),
        keep: tuple[str, ...] = ("id", "text", "tokens")) -> DataFrame:
    """Tokenize, decode, expand, realign -> (``keep``, BIO_anno, ``more``'s columns).

    The texts are shuffled once, to the dictionary entries of their tokens, and annotated where these are.
    """
    columns = [md.path_column(transitions, emissions), *more]
    annotation = tk.RowColumn("BIO_anno", "string", ("text", "tokens", "path"), _annotation)
    return tk.tokenize(docs.select("id", "text"), vocab, more=columns, then=[annotation], keep=[*keep, "BIO_anno", *[m.name for m in more]])


def mood(docs: DataFrame, vocab: DataFrame, model: DataFrame, priors: DataFrame, out: str = "class",
         keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``tokens`` and the class of their texts, or those of these columns to ``keep``; the texts are shuffled once."""
    return tk.tokenize(docs, vocab, more=[md.mood_column(model, priors, name=out)], keep=keep)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """(id, BIO_anno, class) of every row of ``docs`` (id, text); the texts are tokenized once for both.

    A null text is scored as an empty one; repeated and null ids are rows like others.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    tags = tag(docs, models.vocab, models.transitions, models.emissions, more=(md.mood_column(models.mood, models.priors),), keep=("id",))
    return tags.select("id", "BIO_anno", "class")
