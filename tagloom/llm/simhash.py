"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``d`` bits apart have a common variant: a value within ``floor(d / 2)``
bits of the one and ``ceil(d / 2)`` bits of the other.  So every distinct fingerprint emits all its
variants in that radius (2,081 for d = 4), variants are shuffled, and fingerprints that meet on a
variant are linked.  By the triangle inequality a meeting is itself the proof of the distance; the
distance of every link is checked all the same.

The variants travel packed.  The shard of a variant is a linear (xor) function of its bits, so the
shard of ``fingerprint ^ mask`` is ``shard(fingerprint) ^ shard(mask)``: all variants of a
fingerprint for one shard are one row with the fingerprint, and the receiving task spells them
out.  With 2^b shards that is 1 + b + b(b-1)/2 rows for each fingerprint in place of 2,081, and
still every variant meets its equals in exactly one task.  The shard count follows the number of
distinct fingerprints, so that a task holds about ``TASK_VARIANTS``; a task that gets more (near
copies crowd into the same shards) works through them in rounds of that size.

Fingerprints that meet are not linked in all pairs: each meeting adds links to one centre, a task
reduces its links to a spanning forest, and components are found over distinct fingerprints.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm.graph import components
from tagloom.session import materialize

SEED = 42
TASK_VARIANTS = 1 << 22
U64 = np.uint64


# --- fingerprints ------------------------------------------------------------------------

def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 of every shingle of the ASCII-lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest
    line = b" ".join(text.lower().split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    if len(starts) <= shingle:
        return xxh64_intdigest(line, SEED)
    h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])], U64)
    n = len(h)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U64)[0])


def with_fingerprint(docs: DataFrame, shingle: int, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus a struct column with ``fp`` (the 64 bits as a long); null and empty texts: 0."""
    def make(data, offs):
        raw = data.tobytes()
        return [np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())],
                         U64).view(np.int64)]
    return C.add_columns(docs, text, [("fp", "long")], make, "simhash")


# --- variants ----------------------------------------------------------------------------

def ball(radius: int) -> np.ndarray:
    """Xor masks of at most ``radius`` bits."""
    out = [0]
    for w in range(1, radius + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(64), w)]
    return np.array(out, U64)


def shard_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Xor of the ``bits``-wide digits of ``x``: linear, so shard(x ^ m) = shard(x) ^ shard(m)."""
    out = np.zeros(len(x), U64)
    for s in range(0, 64, max(1, bits)):
        out ^= (x >> U64(s)) & U64((1 << bits) - 1)
    return out


def shard_column(x, bits: int):
    """``shard_of`` as a column expression."""
    out = F.lit(0).cast("long")
    for s in range(0, 64, max(1, bits)):
        out = out.bitwiseXOR(F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def meetings(fps: np.ndarray, masks: np.ndarray, inner: int, groups) -> np.ndarray:
    """Links (index pairs) between fingerprints that meet on a variant.

    ``groups`` holds (indices of fingerprints, indices of masks) whose products are the variants;
    the first ``inner`` masks are those within the smaller radius.  A variant's centre is one of
    the fingerprints that reach it by such a mask, and all others there link to it.
    """
    variant, owner, outer = [], [], []
    for f, m in groups:
        if len(f) and len(m):
            variant.append((fps[f][:, None] ^ masks[m][None, :]).ravel())
            owner.append(np.repeat(f.astype(np.int32), len(m)))
            outer.append(np.tile(m >= inner, len(f)))
    if not variant:
        return np.empty((0, 2), np.int64)
    variant, owner, outer = np.concatenate(variant), np.concatenate(owner), np.concatenate(outer)
    if inner < len(masks):
        order = np.lexsort((outer, variant))
    else:
        order = np.argsort(variant)
    variant, owner, outer = variant[order], owner[order], outer[order]
    same = np.zeros(len(variant), bool)
    same[1:] = variant[1:] == variant[:-1]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(variant))))
    hit = np.flatnonzero(same & ~outer[start])
    pair = np.stack([owner[start[hit]], owner[hit]], 1).astype(np.int64)
    return np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least index of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while len(pairs):
        ends = label[pairs]
        pairs = pairs[ends[:, 0] != ends[:, 1]]
        if not len(pairs):
            break
        ends = label[pairs]
        np.minimum.at(label, ends.max(1), ends.min(1))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def shard_links(shard: int, bits: int, fps: np.ndarray, distance: int, limit: int = TASK_VARIANTS) -> np.ndarray:
    """(fingerprint, least linked fingerprint) of one shard's fingerprints, in rounds of ``limit`` variants."""
    fps = np.unique(fps)
    masks, inner = ball((distance + 1) // 2), len(ball(distance // 2))
    m_shard = shard_of(masks, bits)
    f_shard = shard_of(fps, bits)
    size = sum(int((f_shard == (U64(shard) ^ g)).sum()) * int((m_shard == g).sum()) for g in np.unique(m_shard))
    more = max(0, math.ceil(math.log2(max(1, size / limit))))
    # a round takes the variants with one value of ``more`` other linear bits
    taps = C.mix(np.arange(1, more + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    extra = lambda x: sum(((np.bitwise_count(x & t).astype(U64) & U64(1)) << U64(i) for i, t in enumerate(taps)), np.zeros(len(x), U64))
    f_key, m_key = f_shard << U64(more) | extra(fps), m_shard << U64(more) | extra(masks)
    f_order, m_order = np.argsort(f_key, kind="stable"), np.argsort(m_key, kind="stable")
    f_sorted, m_sorted = f_key[f_order], m_key[m_order]
    classes = np.unique(m_key)
    m_from, m_to = np.searchsorted(m_sorted, classes), np.searchsorted(m_sorted, classes, "right")
    found = []
    for r in range(1 << more):
        want = classes ^ (U64(shard) << U64(more) | U64(r))
        f_from, f_to = np.searchsorted(f_sorted, want), np.searchsorted(f_sorted, want, "right")
        pairs = meetings(fps, masks, inner, ((f_order[a:b], m_order[c:d]) for a, b, c, d in zip(f_from, f_to, m_from, m_to)))
        near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= distance
        found.append(pairs[near])
    label = forest(len(fps), np.concatenate(found))
    child = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[child], fps[label[child]]], 1)


def fingerprint_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) that span all pairs within ``distance``."""
    masks = ball((distance + 1) // 2)
    n = distinct.count()
    bits = min(48, max(2, math.ceil(math.log2(max(1, n * len(masks) / TASK_VARIANTS)))))
    steps = [int(x) for x in np.unique(shard_of(masks, bits))]
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"))
    rows = rows.select("fp", shard_column(F.col("fp"), bits).bitwiseXOR(F.col("step")).alias("shard"))

    def run(key, frame):
        links = shard_links(int(key[0]), bits, frame["fp"].to_numpy(np.int64).view(U64), distance).view(np.int64)
        return pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})

    return rows.groupBy("shard").applyInPandas(run, "u long, v long")


# --- documents ---------------------------------------------------------------------------

def classes(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``rows`` (doc_id, fp): the least doc_id reachable."""
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    root = components(fingerprint_links(first.select("fp"), distance), "simhash-links").withColumnRenamed("u", "fp")
    rooted = first.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and link like others; a null doc_id links too but
    names no class unless nothing else does (then component_id is null).  Repeated rows share
    their class.  Other columns are not read.
    """
    found, s = with_fingerprint(C.text_rows(docs), shingle)
    rows = materialize(found.select("doc_id", F.col(f"{s}.fp").alias("fp")), "simhash-rows")
    return rows.join(classes(rows, distance), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id.

    Rows with a null doc_id cannot be named as a group's document and stay.  Of repeated rows
    with that doc_id and one text, one stays.
    """
    found = materialize(near_duplicates(docs, shingle, distance), "simhash-found")
    keep = (found.where("doc_id = component_id").groupBy("doc_id", "fp").agg((F.count("*") > 1).alias("again"))
            .groupBy("doc_id").agg(F.max("again").alias("again")))
    keep = materialize(keep, "simhash-keep")
    # always a sort-merge join: the documents to keep grow with the corpus
    kept = docs.join(keep.where("not again").select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    if keep.where("again").limit(1).count():
        again = docs.join(keep.where("again").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
        kept = kept.union(again.dropDuplicates(["doc_id", "text"]))
    return kept.union(docs.where("doc_id is null"))
