"""Hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and non-ASCII characters, or runs of other visible characters,
case kept, so shouting and decoration are words of their own.  Unigrams and bigrams are hashed to
``BUCKETS`` features; a text's vector holds the shares of its n-grams (times ``SCALE``), so the
score is a sparse dot product: the mean weight of its n-grams plus a bias.  A bigram of one word
twice is hashed without the word, so stuttering generalises to unseen words; n-grams of fewer
than ``MIN_TEXTS`` training texts are left out, since they can only memorise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tagloom.llm import common as C

BUCKETS = 1 << 18
SCALE = 32.0
MIN_TEXTS = 3

_CLASS = np.full(256, 2, np.int8)
_CLASS[list(C.WHITESPACE)] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of a slice, texts in order within unigrams and bigrams."""
    starts, ends = C.runs(_CLASS[data], offs)
    text = np.searchsorted(offs, starts, "right") - 1
    h = C.SpanHash(data)(starts, ends)
    pairs = C.windows(h, 2)
    pairs[h[1:] == h[:-1]] = C.U64(1)
    inside = text[1:] == text[:-1] if len(text) > 1 else np.empty(0, bool)
    bucket = np.concatenate([h, pairs[inside]]) & C.U64(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate([text, text[1:][inside] if len(text) > 1 else text[:0]])


class Ftrl:
    """Per-coordinate FTRL-proximal state for one linear output."""

    def __init__(self, size, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step for the unique coordinates ``at``, at which the weights were ``w``."""
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def vectors(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vector (unique coordinates, values) of every text; the bias is coordinate ``BUCKETS``."""
    import pyarrow as pa
    out = []
    for lo, hi, data, offs in C.slices(*C.utf8(pa.array(texts, pa.string()))):
        bucket, text = features(data, offs)
        key, count = np.unique(text * (BUCKETS + 1) + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1) * (BUCKETS + 1))
        for i in range(hi - lo):
            at, c = key[cut[i]:cut[i + 1]] - i * (BUCKETS + 1), count[cut[i]:cut[i + 1]]
            out.append((np.append(at, BUCKETS), np.append(c * (SCALE / max(1, c.sum())), 1.0)))
    return out


def fit(texts: list, y: np.ndarray, weight: np.ndarray, epochs: int = 3, alpha: float = 0.5,
        beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 3) -> np.ndarray:
    """Weights (BUCKETS + bias) after ``epochs`` passes of one-example updates in a seeded order."""
    rows = vectors(texts)
    seen = np.bincount(np.concatenate([at for at, _ in rows]), minlength=BUCKETS + 1) >= min(MIN_TEXTS, len(rows))
    rows = [(at[seen[at]], x[seen[at]]) for at, x in rows]
    state = Ftrl(BUCKETS + 1, alpha, beta, l1, l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = state.weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            state.update(at, w, weight[i] * (p - y[i]) * x)
    return state.weights().astype(np.float32)


def scorer(model):
    """Function for ``common.add_columns`` from a broadcast weight vector."""
    def make(data, offs):
        w = model.value
        bucket, text = features(data, offs)
        n = len(offs) - 1
        total = np.bincount(text, w[bucket], n)
        seen = np.maximum(np.bincount(text, minlength=n), 1)
        return [1 / (1 + np.exp(-np.clip(total * SCALE / seen + w[BUCKETS], -30, 30)))]
    return make


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> np.ndarray:
    """Fit on about ``per_class`` labelled texts of each class, weighted back to the class sizes.

    ``docs`` is (doc_id, text), ``labels`` (doc_id, label 0/1).  Without labelled texts all
    weights are zero and every score is 0.5.
    """
    sample, shares = C.sample_by_class(docs, labels, per_class)
    size = {k: 1 / v for k, v in shares.items()}
    top = max(size.values(), default=1.0)

    def run(rows):
        y = rows["label"].to_numpy().astype(float)
        weight = np.array([size[k] / top for k in rows["label"]])
        return fit(rows["text"].tolist(), y, weight).tobytes()

    got = C.train_in_one_task(sample, run)
    return np.frombuffer(got, np.float32) if got else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus a struct column with ``score``: the probability of label 1 (empty: the bias's).

    The model is ``BUCKETS`` + 1 floats (1 MB), which is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)
    return C.add_columns(docs, text, [("score", "double")], scorer(model), "scored")
