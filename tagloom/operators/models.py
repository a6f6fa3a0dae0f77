"""Count-based tagging and mood models as Spark jobs.

Learning is aggregation: transition and emission counts for the tagger, token counts per
class for the mood model, all with add-one smoothing.  Every count is a ``groupBy`` with
map-side partial aggregation, so a hot token is combined inside each task before the
shuffle.  Fit, audit, score and decode use the whole text with one frame.

Scores are logarithms in millionths, as integers: sums are exact in any engine and order, so
ties are real ties and go to the lowest label or class.

Model sizes and how they travel: the transition model is at most 12 x 12 (a proven bound) and
travels with the tasks; emission and mood models grow with the vocabulary.  While texts are
tokenized they are joined to the corpus's token dictionary (``path_column``, ``mood_column``); rows that
have tokens already are cut into blocks of the same kind (``with_emissions``).  Decoding works on whole
texts, one numpy step per position for all texts of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.constants import ALL_LABELS, ENTITY_LABELS, EOS, FORBIDDEN, SOS
from tagloom.functions import bio, kernels
from tagloom.operators import dictionary as dy
from tagloom.operators.lookup import attach
from tagloom.operators.tokenize import TokenColumn, lists, one, row_bytes, slices
from tagloom.session import materialize

N_TAG = len(ENTITY_LABELS)          # the decoder ranges over the 9 entity labels
N_ALL = len(ALL_LABELS)
MICRO = 1_000_000
POSITIONS = 1 << 17                 # decoded at a time: what a decoder holds, besides one text


def micro(log: Column) -> Column:
    return F.round(log * MICRO).cast("long")


# ----------------------------------------------------------------------------------
# Allowed transitions
# ----------------------------------------------------------------------------------
def allowed(frm: Column, to: Column) -> Column:
    """Effective rule of the constrained tagger: ``to`` is O, [EOS] or any B-*, or
    ``to`` is the inner form of ``from``."""
    return (to.isin("O", EOS) | to.startswith("B-") | (to == bio.bio_inner(frm)))


def transition_pairs(spark) -> DataFrame:
    """All 12 x 12 label pairs from one generated range (no join): (from_label, to_label)."""
    names = F.array(*[F.lit(n) for n in ALL_LABELS])
    r = spark.range(N_ALL * N_ALL)
    return r.select(F.element_at(names, (F.col("id") / N_ALL).cast("int") + 1).alias("from_label"),
                    F.element_at(names, F.pmod("id", F.lit(N_ALL)).cast("int") + 1).alias("to_label"))


def framed_bigrams(rows: DataFrame, labels: str = "token_labels", keep: tuple[str, ...] = ()) -> DataFrame:
    """Label bigrams of every framed text ([SOS] + labels + [EOS]) -> (keep.., pos, from_label, to_label)."""
    framed = F.concat(F.array(F.lit(SOS)), F.col(labels), F.array(F.lit(EOS)))
    f = rows.select(*keep, framed.alias("__f"))
    pairs = F.arrays_zip(F.slice("__f", F.lit(1), F.size("__f") - 1).alias("f"), F.slice("__f", F.lit(2), F.size("__f") - 1).alias("t"))
    out = f.select(*keep, F.posexplode_outer(pairs).alias("pos", "b")).where(F.col("b").isNotNull())
    return out.select(*keep, F.col("pos").cast("long").alias("pos"), F.col("b.f").alias("from_label"), F.col("b.t").alias("to_label"))


def combined(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray],
             keys: Callable[[pa.RecordBatch], tuple[pa.Array, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (``names``.., n): how often each combination of the keys occurs in a slice of a batch."""
    for batch in batches:
        for part in slices(batch, size(batch)):
            coded = [kernels.encoded(k) for k in keys(part)]
            code = np.zeros(len(coded[0][0]), np.int64)
            for codes, distinct in coded:
                code = code * (len(distinct) + 1) + codes + 1
            code, n = np.unique(code, return_counts=True)
            out = []
            for _, distinct in reversed(coded):
                code, own = np.divmod(code, len(distinct) + 1)
                out.append(distinct.take(pa.array(own - 1, mask=own == 0)))
            yield pa.RecordBatch.from_arrays([*out[::-1], pa.array(n.astype(np.int64))], names=[*names, "n"])


def bigram_counts(rows: DataFrame, labels: str = "token_labels") -> DataFrame:
    """(from_label, to_label, n): the pairs of ``framed_bigrams``, counted slice by slice before they are summed."""
    def pairs(part: pa.RecordBatch) -> tuple[pa.Array, ...]:
        column = part.column(0).drop_null()
        values, at = kernels.flat_list(column)
        texts = len(column)
        codes, names = kernels.coded(values)
        # every text's labels with its frame around them
        framed = np.empty(len(codes) + 2 * texts, np.int64)
        inside = np.ones(len(framed), bool)
        inside[at[:-1] + 2 * np.arange(texts)] = inside[at[1:] + 2 * np.arange(texts) + 1] = False
        framed[inside] = codes
        framed[at[:-1] + 2 * np.arange(texts)], framed[at[1:] + 2 * np.arange(texts) + 1] = len(names), len(names) + 1
        opens = np.ones(len(framed), bool)
        opens[at[1:] + 2 * np.arange(texts) + 1] = False
        begin = np.flatnonzero(opens)
        return tuple(kernels.named([*names, SOS, EOS], framed[p]) for p in (begin, begin + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return combined(batches, lambda b: row_bytes(b.column(0)), pairs, ["from_label", "to_label"])

    each = rows.select(labels).mapInArrow(count, "from_label string, to_label string, n long")
    return each.groupBy("from_label", "to_label").agg(F.sum("n").alias("n"))


def fit_transitions(spark, rows: DataFrame) -> DataFrame:
    """M03 (transitions): log P(to | from) with add-one smoothing; forbidden pairs -100.

    -> (from_label, to_label, n, score, allowed, micro)
    """
    counts = materialize(bigram_counts(rows), "bigrams", bounded=True)
    pairs = transition_pairs(spark).join(counts, ["from_label", "to_label"], "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)))
    tot = counts.groupBy("from_label").agg(F.sum("n").alias("n_from"))
    t = pairs.join(tot, "from_label", "left").withColumn("n_from", F.coalesce("n_from", F.lit(0)))
    ok = allowed(F.col("from_label"), F.col("to_label"))
    score = F.when(ok, F.log((F.col("n") + 1) / (F.col("n_from") + N_ALL))).otherwise(F.lit(FORBIDDEN))
    return t.select("from_label", "to_label", "n", score.alias("score"), ok.alias("allowed"), micro(score).alias("micro"))


def transition_arrays(trans: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start[9], tr[9][9], end[9] of the fitted transitions (at most 12 x 12 rows are read)."""
    idx = {n: i for i, n in enumerate(ALL_LABELS)}
    cells = {(idx[r["from_label"]], idx[r["to_label"]]): r["micro"] for r in trans.select("from_label", "to_label", "micro").collect()}
    full = np.array([[cells[i, j] for j in range(N_ALL)] for i in range(N_ALL)], np.int64)
    return full[idx[SOS], :N_TAG], full[:N_TAG, :N_TAG], full[:N_TAG, idx[EOS]]


# ----------------------------------------------------------------------------------
# M03 (emissions)
# ----------------------------------------------------------------------------------
def token_label_counts(rows: DataFrame) -> DataFrame:
    """(label, token, n) of the positions with an entity label, counted slice by slice before they are summed.

    A text without tokens or without labels takes no part; a label past the tokens has a null token.
    """
    def pairs(part: pa.RecordBatch) -> tuple[pa.Array, ...]:
        part = part.filter(pa.array(~kernels.any_null(*part.columns)))
        (words, token_at), (values, label_at) = (kernels.flat_list(c) for c in part.columns)
        place = np.arange(len(values)) - label_at[:-1][kernels.row_of(label_at)]
        row = kernels.row_of(label_at)
        known = pc.is_in(values, value_set=pa.array(ENTITY_LABELS)).to_numpy(zero_copy_only=False)
        at = (token_at[:-1][row] + place)[known]
        past = (place >= np.diff(token_at)[row])[known]
        return values.filter(pa.array(known)), words.take(pa.array(at, mask=past))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return combined(batches, lambda b: row_bytes(b.column(0)) + row_bytes(b.column(1)), pairs, ["label", "token"])

    each = rows.select("tokens", "token_labels").mapInArrow(count, "label string, token string, n long")
    return each.groupBy("label", "token").agg(F.sum("n").alias("n"))


def fit_emissions(rows: DataFrame) -> DataFrame:
    """M03 (emissions): log P(token | label), add-one over the training vocabulary of V tokens.

    -> (label, token, n, logp, n_label, v); an unseen pair scores ``log(1 / (n_label + V))``.
    """
    counts = materialize(token_label_counts(rows), "token_labels", bounded=True)        # counted once for three uses
    v = counts.select("token").distinct().agg(F.count(F.lit(1))).scalar()
    per_label = counts.groupBy("label").agg(F.sum("n").alias("n_label"))
    return (counts.join(F.broadcast(per_label), "label")          # <= 9 rows: proven bound
            .select("label", "token", "n", F.log((F.col("n") + 1) / (F.col("n_label") + v)).alias("logp"),
                    "n_label", v.alias("v")))


def emission_vectors(emissions: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(token, scores[9]) of seen tokens and the scores of an unseen one; a label that the
    training never had counts 0, like any other count."""
    totals = {r["label"]: r["n_label"] for r in emissions.groupBy("label").agg(F.max("n_label").alias("n_label")).collect()}
    v = emissions.agg(F.max("v")).first()[0] or 1
    unseen = [int(math.floor(math.log(1.0 / (totals.get(n, 0) + v)) * MICRO + 0.5)) for n in ENTITY_LABELS]
    cells = [F.coalesce(F.max(F.when(F.col("label") == n, micro(F.col("logp")))), F.lit(u)) for n, u in zip(ENTITY_LABELS, unseen)]
    return emissions.groupBy("token").agg(F.array(*cells).alias("scores")), np.array(unseen, np.int64)


def with_emissions(rows: DataFrame, vec: DataFrame, unseen: np.ndarray, name: str, kind: str,
                   work: Callable[[np.ndarray, np.ndarray, pa.Table], pa.Array]) -> DataFrame:
    """``rows`` plus the column ``work(scores, offsets, rows)``, block by block; null where ``tokens`` is.

    ``scores`` [positions, 9] are the emission scores of all positions of the block's texts, ``offsets`` the
    places of the texts among them.
    """
    blocks = dy.in_blocks(rows, "tokens")
    used = dy.block_keys(blocks, "tokens", "token")
    names = rows.columns
    schema = StructType([*[f for f in rows.schema.fields if f.name != name], *StructType.fromDDL(f"`{name}` {kind}").fields])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = one(left.column("tokens"))
        words, offsets = kernels.flat_list(tokens)
        entry = pc.fill_null(pc.index_in(words, value_set=one(right.column("token"))), len(right)).to_numpy(zero_copy_only=False)
        scores = np.vstack([value_matrix(one(right.column("scores")), unseen), unseen])[entry]
        made = work(scores, offsets, left)
        made = pc.if_else(tokens.is_null(), pa.scalar(None, made.type), made) if tokens.null_count else made
        kept = [c for c in names if c != name]
        return pa.Table.from_arrays([*[left.column(c) for c in kept], made], names=[*kept, name])

    return dy.per_block(blocks, used, vec, "token", block, schema)


# ----------------------------------------------------------------------------------
# Constrained Viterbi decode; M05: path score; M08: per-token argmax
# ----------------------------------------------------------------------------------
def viterbi(mats: list[np.ndarray], start: np.ndarray, tr: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Best label-id path of every text; one step per position for all texts still running.

    Ties take the lowest label id, in every step and at the end.  Scores are held in multiples of ``unit``
    with the label they come from, lowest first, in the low bits: one maximum gives both.
    """
    n = np.array([len(m) for m in mats], np.int64)
    order = np.argsort(-n, kind="stable")
    length = n[order]
    live = int((length > 0).sum())
    if not live:
        return [np.empty(0, np.int64) for _ in mats]
    length, labels = length[:live], len(tr)
    unit = 1 << labels.bit_length()
    flat = np.concatenate([mats[i] for i in order[:live]])
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    running = live - np.searchsorted(length[::-1], np.arange(int(length[0])), "right")    # texts longer than t
    first = np.concatenate([[0], np.cumsum(running)])
    # positions by step, then by text
    place = first[np.arange(len(flat)) - np.repeat(at, length)] + np.repeat(np.arange(live), length)
    scores = np.empty((labels, len(flat)), np.int64)
    scores[:, place] = flat.T * unit
    step = (tr * unit + (labels - 1 - np.arange(labels))[:, None])[:, :, None]
    score = start[:, None] * unit + scores[:, :live]
    back = np.empty((labels, len(flat)), np.int8)
    spans = list(zip(first[1:-1].tolist(), first[2:].tolist()))
    for lo, hi in spans:
        best = (score[:, None, :hi - lo] + step).max(0)
        np.subtract(labels - 1, best & (unit - 1), out=back[:, lo:hi], casting="unsafe")
        np.add(best & -unit, scores[:, lo:hi], out=score[:, :hi - lo])
    cur = (score + end[:, None] * unit).argmax(0)
    by_step, every, back = np.empty(len(flat), np.int64), np.arange(len(flat)), back.reshape(-1)
    for lo, hi in reversed(spans):
        by_step[lo:hi] = cur[:hi - lo]
        cur[:hi - lo] = back.take(cur[:hi - lo] * len(flat) + every[lo:hi])
    by_step[:live] = cur
    paths = by_step[place]
    out = [np.empty(0, np.int64)] * len(mats)
    for k, i in enumerate(order[:live]):
        out[i] = paths[at[k]:at[k] + length[k]]
    return out


def decode(rows: DataFrame, trans: DataFrame, emis: DataFrame, out: str = "path") -> DataFrame:
    """Add the best label-id path of each row's ``tokens`` under emissions and transitions."""
    vec, unseen = emission_vectors(emis)
    start, tr, end = transition_arrays(trans)
    return with_emissions(rows, vec, unseen, out, "array<int>", lambda scores, offsets, _rows: best_paths(scores, offsets, start, tr, end))


def best_paths(scores: np.ndarray, offsets: np.ndarray, start: np.ndarray, tr: np.ndarray, end: np.ndarray) -> pa.Array:
    """The best path of every text of a block; texts of like length are decoded together, about ``POSITIONS`` at a time."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    group = (np.cumsum(n[order]) - n[order]) // POSITIONS
    out = np.empty(int(offsets[-1]), np.int32)
    for texts in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        for i, path in zip(texts.tolist(), viterbi([scores[offsets[i]:offsets[i + 1]] for i in texts.tolist()], start, tr, end)):
            out[offsets[i]:offsets[i + 1]] = path
    return lists(out, offsets, pa.int32())


def value_matrix(values: pa.Array, missing: np.ndarray) -> np.ndarray:
    """[entries, len(missing)] of a list column; ``missing`` where it is null."""
    out = np.tile(missing, (len(values), 1))
    out[values.is_valid().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy().reshape(-1, len(missing))
    return out


def path_column(trans: DataFrame, emis: DataFrame, name: str = "path") -> TokenColumn:
    """M04 while tokenizing: the best label-id path of each text."""
    vec, unseen = emission_vectors(emis)
    start, tr, end = transition_arrays(trans)

    def paths(scores: pa.Array, entry: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return best_paths(value_matrix(scores, unseen)[entry], offsets, start, tr, end)

    return TokenColumn(name, "array<int>", lambda tokens: vec, "scores", paths)


def argmax_tags(rows: DataFrame, emis: DataFrame, out: str = "path") -> DataFrame:
    """M08, unconstrained: the label with the best emission score at every position."""
    vec, unseen = emission_vectors(emis)
    return with_emissions(rows, vec, unseen, out, "array<int>", lambda scores, offsets, _rows: lists(scores.argmax(1), offsets, pa.int32()))


def path_scores(rows: DataFrame, trans: DataFrame, emis: DataFrame, ids: str, out: str = "score") -> DataFrame:
    """Add the score (millionths) of each row's own label path; an empty text scores 0."""
    vec, unseen = emission_vectors(emis)
    start, tr, end = transition_arrays(trans)

    def score(scores: np.ndarray, offsets: np.ndarray, block: pa.Table) -> pa.Array:
        got, paths = [], kernels.flat_list(one(block.column(ids)))
        of = paths[0].to_numpy(zero_copy_only=False).astype(np.int64)
        for at, a, b in zip(offsets[:-1].tolist(), paths[1][:-1].tolist(), paths[1][1:].tolist()):
            p = of[a:b]
            got.append(int(start[p[0]] + scores[at + np.arange(b - a), p].sum() + tr[p[:-1], p[1:]].sum() + end[p[-1]]) if b > a else 0)
        return pa.array(got, pa.int64())

    return with_emissions(rows, vec, unseen, out, "long", score)


# ----------------------------------------------------------------------------------
# Multinomial naive Bayes over tokens
# ----------------------------------------------------------------------------------
def fit_mood(docs: DataFrame, tokens: str = "tokens", cls: str = "class") -> tuple[DataFrame, DataFrame]:
    """(class, token, n, logp) and priors (class, n_docs, prior, n_class, v)."""
    rows = bio.explode_rows(docs.select(cls, tokens), tokens, "token", [cls])
    counts = materialize(rows.groupBy(cls, "token").agg(F.count(F.lit(1)).alias("n")), "mood_counts")
    v = counts.select("token").distinct().agg(F.count(F.lit(1))).scalar()
    per_class = counts.groupBy(cls).agg(F.sum("n").alias("n_class"))
    model = (counts.join(F.broadcast(per_class), cls)               # 3 rows: proven bound
             .select(cls, "token", "n", F.log((F.col("n") + 1) / (F.col("n_class") + v)).alias("logp"),
                     "n_class"))
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    priors = docs.groupBy(cls).agg(F.count(F.lit(1)).alias("n_docs")) \
        .withColumn("prior", F.log(F.col("n_docs") / n_docs)).withColumn("v", v)
    return model, priors.join(per_class, cls)


def mood_vectors(model: DataFrame, priors: DataFrame, cls: str = "class") -> tuple[DataFrame, np.ndarray]:
    """(token, scores[3]) of the tokens seen in training, and the priors of the classes."""
    classes = [0, 1, 2]
    p = {r[cls]: r for r in priors.select(cls, micro(F.col("prior")).alias("prior"),
                                          micro(F.log(F.lit(1.0) / (F.col("n_class") + F.col("v")))).alias("unseen")).collect()}
    never = -(1 << 60)                                              # a class without training texts
    wide = model.groupBy("token").agg(F.array(*[F.coalesce(F.max(F.when(F.col(cls) == c, micro(F.col("logp")))),
                                                            F.lit(p[c]["unseen"] if c in p else 0)) for c in classes]).alias("scores"))
    prior = np.array([p[c]["prior"] if c in p else never for c in classes], np.int64)
    return wide, prior


def mood_column(model: DataFrame, priors: DataFrame, cls: str = "class", name: str = "class") -> TokenColumn:
    """M07 while tokenizing: the class of each text, by the rule of ``predict_mood``."""
    wide, prior = mood_vectors(model, priors, cls)

    def best(scores: pa.Array, entry: np.ndarray, offsets: np.ndarray) -> pa.Array:
        none = np.zeros(len(prior), np.int64)                       # a token never seen adds nothing
        sums = np.vstack([none, np.cumsum(value_matrix(scores, none)[entry], axis=0)])
        return pa.array((prior + sums[offsets[1:]] - sums[offsets[:-1]]).argmax(1), pa.int32())

    return TokenColumn(name, "int", lambda tokens: wide, "scores", best)


def predict_mood(docs: DataFrame, model: DataFrame, priors: DataFrame, tokens: str = "tokens", cls: str = "class",
                 out: str = "pred") -> DataFrame:
    """``docs`` plus the argmax over classes of prior + token log-likelihoods; ties: lowest class.

    Tokens never seen in training are ignored; a seen token missing for a class scores
    ``log(1 / (N_class + V))``.  The tokens are looked up once per text and row.
    """
    wide, prior = mood_vectors(model, priors, cls)

    @F.pandas_udf("int")
    def best(rows: pd.Series, hits: pd.Series) -> pd.Series:
        got = []
        for t, h in zip(rows, hits):
            of = {} if h is None else {x["token"]: x["scores"] for x in h}
            known = [of[x] for x in t if x in of]
            got.append(int((prior + (np.array(known, np.int64).sum(0) if known else 0)).argmax()))
        return pd.Series(got)

    return attach(docs, F.col(tokens), wide, "token", ["scores"], "__mood").withColumn(out, best(tokens, "__mood")).drop("__mood")
