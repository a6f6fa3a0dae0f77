"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed table rows, one for the word and one for each of its first
``PREFIXES`` bytes, so that inflected and compounded forms share a part and two different words
rarely share all.  Filters of several widths slide over the words, the largest activation of each filter
in a text is kept, and a logistic layer turns these into a probability.  Training is AdaGrad on a
bounded sample; the gradient flows only through the pooled positions, so it is sparse.

The score never sees the language.  It only picks the threshold of the verdict: for every language
the cutoff with the best F1 over an eighth of all labelled texts, chosen by a hash of the id and
scored by a model that was trained without them, counted as a histogram.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.session import materialize

BUCKETS = 1 << 16
PREFIXES = (4, 5)
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
BINS = 200
MIN_POSITIVE = 20
MAX_LANGUAGES = 512


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = C.lut([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of every word, word offsets of the texts); A-Z are lower-cased."""
    data = _LOWER[data]
    starts, ends = C.runs(_WORD[data].view(np.int8), offs)
    span = C.SpanHash(data)
    h = [span(starts, ends)] + [C.mix(span(starts, np.minimum(starts + n, ends)) + C.U64(n)) for n in PREFIXES]
    return (np.stack(h, 1) & C.U64(BUCKETS - 1)).astype(np.int32), np.searchsorted(starts, offs)


def embed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = table[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        x += table[rows[:, k]]
    return x


def convolve(model: dict, x: np.ndarray) -> list[np.ndarray]:
    """Filter activations at every start, one array per width."""
    y = x @ model["taps"]                                      # all taps of all filters at once
    out, at = [], 0
    for w in WIDTHS:
        n = len(x) - w + 1
        if n > 0:
            a = y[:n, at:at + FILTERS].copy()
            for j in range(1, w):
                a += y[j:j + n, at + j * FILTERS:at + (j + 1) * FILTERS]
            out.append(a + model[f"b{w}"])
        else:
            out.append(np.empty((0, FILTERS), np.float32))
        at += w * FILTERS
    return out


def pooled(model: dict, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest activation (at least 0) of every filter in every text."""
    n = len(first) - 1
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    if not len(rows):
        return out
    acts = convolve(model, embed(model["e"], rows))
    length = np.diff(first)
    for k, (w, a) in enumerate(zip(WIDTHS, acts)):
        some = np.flatnonzero(length >= w)
        if not len(some):
            continue
        # windows of a text: first[i] .. first[i + 1] - w; odd segments of the reduction are the gaps
        cuts = np.stack([first[some], first[some + 1] - w + 1], 1).ravel()
        if cuts[-1] == len(a):
            cuts = cuts[:-1]
        top = np.maximum.reduceat(a, cuts, axis=0)[::2]
        out[some, k * FILTERS:(k + 1) * FILTERS] = np.maximum(top, 0)
    return out


def probability(model: dict, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    z = pooled(model, rows, first) @ model["u"] + model["c"]
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fresh(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    f4 = np.float32
    model = {"e": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(f4),
             "taps": rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(f4),
             "u": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(f4), "c": f4(-1.0)}
    return model | {f"b{w}": np.zeros(FILTERS, f4) for w in WIDTHS}


def word_rows(texts: list) -> list[np.ndarray]:
    import pyarrow as pa
    out = []
    for _, _, data, offs in C.slices(*C.utf8(pa.array(texts, pa.string()))):
        rows, first = words(data, offs)
        out += [rows[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


def fit(texts: list, y: np.ndarray, weight: np.ndarray, epochs: int = 4, batch: int = 32, steps: int = 300,
        rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> dict:
    """Train on whole texts; ``weight`` scales an example's gradient.

    ``epochs`` passes, or as many as make ``steps`` batches where the sample is small.
    """
    rows = word_rows(texts)
    model = fresh(seed)
    state = {k: np.full(np.shape(v), 1e-3, np.float32) for k, v in model.items()}
    rng = np.random.default_rng(seed)

    def step(name, grad, at=slice(None)):
        state[name][at] += grad * grad
        model[name][at] -= rate * grad / np.sqrt(state[name][at])

    for _ in range(max(epochs, -(-steps * batch // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            chosen = order[lo:lo + batch]
            grads = {k: np.zeros(np.shape(v), np.float32) for k, v in model.items() if k != "e"}
            e_at, e_grad = [], []
            for i in chosen:
                x = embed(model["e"], rows[i])
                acts = convolve(model, x)
                peaks = [a.argmax(0) if len(a) else None for a in acts]
                pool = np.concatenate([np.maximum(a[p, np.arange(FILTERS)], 0) if len(a) else np.zeros(FILTERS, np.float32)
                                       for a, p in zip(acts, peaks)])
                p1 = 1 / (1 + np.exp(-np.clip(pool @ model["u"] + model["c"], -30, 30)))
                g = np.float32(weight[i] * (p1 - y[i]))
                grads["u"] += g * pool
                grads["c"] += g
                back = g * model["u"] * (pool > 0)
                at = 0
                for k, w in enumerate(WIDTHS):
                    if peaks[k] is not None:
                        gk = back[k * FILTERS:(k + 1) * FILTERS]
                        grads[f"b{w}"] += gk
                        for j in range(w):
                            cols = slice(at + j * FILTERS, at + (j + 1) * FILTERS)
                            here = peaks[k] + j
                            grads["taps"][:, cols] += x[here].T * gk
                            e_grad.append((model["taps"][:, cols] * gk).T)
                            e_at.append(rows[i][here])
                    at += w * FILTERS
            for name, grad in grads.items():
                if name == "c":
                    state["c"] = state["c"] + grad * grad
                    model["c"] = model["c"] - rate * grad / np.sqrt(state["c"])
                else:
                    step(name, grad + decay * model[name])
            if e_at:
                at, grad = np.concatenate(e_at), np.concatenate(e_grad)
                at, back = np.unique(at.T.ravel(), return_inverse=True)
                total = np.zeros((len(at), DIM), np.float32)
                np.add.at(total, back.reshape(-1), np.concatenate([grad] * rows[0].shape[1]))
                step("e", total + decay * model["e"][at], at)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> dict:
    """Fit on about ``per_class`` labelled texts of each class.

    ``docs`` is (doc_id, text), ``labels`` (doc_id, label 0/1).  Without labelled texts of both
    classes the model is a constant (the share of the known class, 0 without any).
    """
    sample, shares = C.sample_by_class(docs, labels, per_class)
    if len(shares) < 2:
        model = fresh(0)
        model["u"][:] = 0
        return model | {"c": np.float32(5.0 if shares.get(1) else -5.0)}
    size = {k: 1 / v for k, v in shares.items()}
    top = max(size.values())

    def run(rows):
        weight = np.array([max(0.25, size[k] / top) for k in rows["label"]])
        return pickle.dumps(fit(rows["text"].tolist(), rows["label"].to_numpy().astype(float), weight))

    got = C.train_in_one_task(sample, run)
    return pickle.loads(got) if got else fresh(0) | {"u": np.zeros(FILTERS * len(WIDTHS), np.float32), "c": np.float32(-5.0)}


def score(docs: DataFrame, model: dict, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus a struct column with ``score``; null and empty texts score as the bias does.

    The model (4 MB, of fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(data, offs):
        out = []
        for _, _, part, own in C.slices(data, offs, 1 << 20):
            out.append(probability(shared.value, *words(part, own)))
        return [np.concatenate(out)]

    return C.add_columns(docs, text, [("score", "double")], make, "toxicity")


def best_cutoff(histogram: dict) -> float:
    """Cutoff (a bin edge) with the best F1; between equal ones the middle."""
    pos = np.array([histogram.get((b, 1), 0) for b in range(BINS)])
    neg = np.array([histogram.get((b, 0), 0) for b in range(BINS)])
    hit, false = pos[::-1].cumsum()[::-1], neg[::-1].cumsum()[::-1]
    f1 = 2 * hit / np.maximum(hit + false + pos.sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(best[len(best) // 2] / BINS)


def thresholds(scored: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Cutoffs by language, and the one for all, from every labelled row of ``scored``.

    ``scored`` is (doc_id, lang, score).  A language with fewer than ``MIN_POSITIVE`` positive
    labels has no cutoff of its own, and neither has one beyond the ``MAX_LANGUAGES`` with the most
    of them: they share the one for all.  So at most ``MAX_LANGUAGES`` x ``BINS`` x 2 counts are collected.
    """
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    part = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    counts = (scored.join(labels, "doc_id").groupBy(F.coalesce("lang", F.lit("und")).alias("lang"), part.alias("bin"),
                                                    (F.col("label") >= 1).cast("int").alias("y"))
              .agg(F.count("*").alias("n")))
    counts = materialize(counts, "toxicity-bins")
    whole = {(r["bin"], r["y"]): r["n"] for r in counts.groupBy("bin", "y").agg(F.sum("n").alias("n")).collect()}
    known = (counts.groupBy("lang").agg(F.sum(F.col("n") * F.col("y")).alias("positive")).where(F.col("positive") >= MIN_POSITIVE)
             .orderBy(F.desc("positive"), "lang").limit(MAX_LANGUAGES).select("lang"))
    by: dict[str, dict] = {}
    for r in counts.join(F.broadcast(known), "lang").collect():   # at most MAX_LANGUAGES names
        by.setdefault(r["lang"], {})[r["bin"], r["y"]] = r["n"]
    return {k: best_cutoff(h) for k, h in by.items()}, best_cutoff(whole) if whole else 0.5


def judge(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic), one row per row of ``docs`` (doc_id, text, lang).

    ``labels`` is (doc_id, label 0/1); null ids and labels do not count and the largest label of
    an id holds.  Null languages share the threshold of all.  Repeated rows are scored each.
    """
    calibrate = F.pmod(F.xxhash64(F.lit(101), F.col("doc_id")), F.lit(8)) == 0
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")

    def scores(rows, labels):
        found, t = score(rows, train(docs.select("doc_id", "text"), labels, per_class))
        return materialize(found.select("doc_id", "lang", F.col(f"{t}.score").alias("score")), "toxicity-scores")

    scored = scores(rows, labels)
    by, whole = thresholds(scores(rows.where(calibrate), labels.where(~calibrate)), labels.where(calibrate))
    cut = F.lit(whole)
    if by:
        table = F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.lit(v))])
        cut = F.coalesce(F.try_element_at(table, F.coalesce("lang", F.lit("und"))), cut)
    return scored.withColumn("threshold", cut).withColumn("toxic", F.col("score") >= F.col("threshold"))
