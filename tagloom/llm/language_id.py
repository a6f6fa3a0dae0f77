"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of one to three code points (letters lower-cased where they are ASCII, digits and
punctuation folded, blank runs to one blank) are hashed to ``BUCKETS`` features.  A text's value of
a feature is its share of the text's n-grams times the feature's inverse document frequency, which
is counted over every training text.  The weights come from follow-the-regularised-leader updates
with elastic-net penalties (the L1 part leaves most of them zero), and one temperature, fitted on
texts that the weights have not seen, calibrates the probabilities.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm.quality_classifier import Ftrl

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 16.0
UNKNOWN = "und"
MAX_LANGUAGES = 512

# one code per byte: letters and non-ASCII bytes stand for themselves, all else for a blank
_CODE = np.zeros(256, np.uint8)
_CODE[0x61:0x7B] = np.arange(0x61, 0x7B)
_CODE[0x41:0x5B] = np.arange(0x61, 0x7B)
_CODE[0x80:] = np.arange(0x80, 0x100)


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every character n-gram of a slice; pure blanks are left out."""
    code = _CODE[data]
    lead = (data & 0xC0) != 0x80                               # first bytes of the code points
    # a blank after a blank (or at a text's start) is dropped
    blank = code == 0
    drop = blank.copy()
    drop[1:] &= blank[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    drop[edge] = blank[edge]
    begin = np.flatnonzero(lead & ~drop)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the code point's bytes as one number
    value = code[begin].astype(np.uint32)
    wide = data[begin] >= 0xC0
    for j in range(1, 4):
        at = begin + j
        ok = wide & (at < len(data))
        at = np.minimum(at, len(data) - 1)
        ok &= ~lead[at]
        value = np.where(ok, (value << np.uint32(8)) | data[at], value)
        wide = ok
    value = (value + np.uint32(1)) * np.uint32(2654435761)
    text = (np.searchsorted(offs, begin, "right") - 1).astype(np.int32)
    buckets, texts = [], []
    h = np.zeros(len(value), np.uint32)
    for order in ORDERS:
        n = len(value) - order + 1
        if n <= 0:
            break
        h = h[:n] * np.uint32(40503) + value[order - 1:order - 1 + n]
        inside = text[order - 1:order - 1 + n] == text[:n]
        if order == 1:
            inside &= code[begin] != 0
        g = h ^ (h >> np.uint32(15))
        g *= np.uint32(2246822519)
        g ^= g >> np.uint32(13)
        g += np.uint32(order * 7919)
        buckets.append((g & np.uint32(BUCKETS - 1))[inside].astype(np.int32))
        texts.append(text[:n][inside])
    return np.concatenate(buckets), np.concatenate(texts)


# --- inverse document frequencies --------------------------------------------------------

def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(texts with the bucket, texts), over every row of ``docs`` (column text).

    Each task sums its own texts' buckets first, so at most ``BUCKETS`` rows leave a task and as
    many reach the driver.
    """
    def run(batches):
        import pyarrow as pa
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for lo, hi, data, offs in C.slices(*C.utf8(batch.column(0)), 1 << 19):
                bucket, text = ngrams(data, offs)
                for a in range(0, hi - lo, 256):               # a flag per text and bucket, some texts at a time
                    mine = (text >= a) & (text < a + 256) if hi - lo > 256 else slice(None)
                    seen = np.zeros((min(256, hi - lo - a), BUCKETS), bool)
                    seen[text[mine] - a, bucket[mine]] = True
                    total += seen.sum(0)
                n += hi - lo
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, BUCKETS)), pa.array(np.append(total[used], n))],
                                         names=["bucket", "c"])

    rows = docs.select("text").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r["bucket"]] = r["c"]
    return out[:BUCKETS], int(out[BUCKETS])


# --- model -------------------------------------------------------------------------------

def vectors(texts: list, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF vector (unique coordinates, values) of every text; the bias is the last one."""
    import pyarrow as pa
    out = []
    for lo, hi, data, offs in C.slices(*C.utf8(pa.array(texts, pa.string()))):
        bucket, text = ngrams(data, offs)
        key, count = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
        for i in range(hi - lo):
            at, c = key[cut[i]:cut[i + 1]] - i * BUCKETS, count[cut[i]:cut[i + 1]]
            out.append((np.append(at, BUCKETS), np.append(c * idf[at] * (SCALE / max(1, c.sum())), 1.0)))
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss (golden-section search)."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, g = -1.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(texts: list, y: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 2, alpha: float = 0.3,
        beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, seed: int = 5) -> np.ndarray:
    """(BUCKETS + bias) x classes weights, divided by the temperature and with the idf folded in.

    Every fifth text sets only the temperature.
    """
    rows = vectors(texts, idf)
    held = np.arange(len(rows)) % 5 == 4
    state = Ftrl((BUCKETS + 1, classes), alpha, beta, l1, l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, x = rows[i]
            w = state.weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            state.update(at, w, x[:, None] * p)
    w = state.weights()
    logits = np.array([x @ w[at] for (at, x), h in zip(rows, held) if h]).reshape(-1, classes)
    w = w / temperature(logits, y[held])
    w[:BUCKETS] *= idf[:, None] * SCALE
    return w.astype(np.float32)


def train(learn: DataFrame, per_language: int = 1500) -> tuple[list[str], np.ndarray]:
    """(languages, weights) from about ``per_language`` texts of each language.

    ``learn`` is (doc_id, text, label) with the language; null labels do not count.  Document
    frequencies are counted over all its labelled texts.  Of more than ``MAX_LANGUAGES`` values those
    with the most texts are learned (ties: by name), so stray values cost no more than they are worth.
    Of a repeated id the longest text may be sampled, of equally long ones the last in binary order.
    """
    learn = learn.where("label is not null")
    learn = learn.withColumn("label", F.col("label").cast("string"))
    most = learn.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LANGUAGES).select("label")
    learn = learn.join(F.broadcast(most), "label").select("doc_id", "text", "label")     # at most MAX_LANGUAGES names
    sample, shares = C.sample_by_class(learn.select("doc_id", "text"), learn.select("doc_id", "label"), per_language, bound=MAX_LANGUAGES)
    languages = sorted(shares)
    if not languages:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    df, n = document_frequency(learn)
    idf = np.log((1 + n) / (1 + df)) + 1
    number = {k: i for i, k in enumerate(languages)}

    def run(rows):
        return fit(rows["text"].tolist(), rows["label"].map(number).to_numpy(), len(languages), idf).tobytes()

    got = C.train_in_one_task(sample, run)
    return languages, np.frombuffer(got, np.float32).reshape(BUCKETS + 1, len(languages))


def predict(docs: DataFrame, languages: list[str], weights: np.ndarray, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus a struct column (lang, score) and its name.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was learned.
    The model is (2^16 + 1) x languages floats, which is broadcast; languages are bounded.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def make(data, offs):
        w, n = model.value, len(offs) - 1
        logits = np.tile(w[BUCKETS].astype(float), (n, 1))
        bucket, owner = ngrams(data, offs)
        seen = np.maximum(np.bincount(owner, minlength=n), 1)
        useful = w[:BUCKETS].any(1)[bucket]
        bucket, owner = bucket[useful], owner[useful]
        for k in range(w.shape[1]):
            logits[:, k] += np.bincount(owner, w[:, k][bucket], n) / seen
        raw = data.tobytes()
        lettered = np.array([any(map(str.isalpha, raw[a:b].decode("utf-8", "replace"))) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], bool)
        if not w.shape[1]:
            lettered[:] = False
            logits = np.zeros((n, 1))
        p = softmax(logits)
        best = p.argmax(1)
        return [[languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())],
                np.where(lettered, p.max(1), 0.0)]

    return C.add_columns(docs, text, [("lang", "string"), ("score", "double")], make, "language")
