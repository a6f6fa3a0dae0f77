"""Quality rules with risk-controlled thresholds.

Every text gets exact counts (words, symbols, repeated lines, repeated 8-word windows) and a few
ratios made from them.  Each ratio is a rule "reject above a cutoff".  The cutoffs are chosen on
labelled holdouts, per stratum (language), so that good texts are rejected only rarely:

* for a stratum, rule and cutoff the null hypothesis is "the rule rejects more than its share of
  the allowed risk of the good texts"; its p-value is the exact lower binomial tail
  P(Bin(good texts, share) <= rejected good texts);
* the cutoffs of one rule in one stratum are tested from lenient to strict, stopping at the first
  that is not rejected (fixed-sequence testing, no correction needed inside a sequence);
* the sequences of all strata and rules share the error rate evenly (Bonferroni).

So with probability ``1 - delta`` no stratum loses more than ``risk`` of its good texts, whatever
the cutoff taken among the certified ones.  Taken is the one that rejects most bad texts net of
good ones (ties: the most lenient).  Where nothing can be certified the rule does not apply.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.session import materialize

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
          ("n_repeat_words", "long"), ("n_lines", "long"), ("n_shouts", "long"), ("n_upper", "long"),
          ("n_ascii_letters", "long"), ("n_echoes", "long")]
#: rule -> (numerator, denominator, cutoffs from lenient to strict)
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", [4, 3, 2, 1.5, 1, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "shouts_per_word": ("n_shouts", "n_words", [4, 3, 2, 1.5, 1, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "upper_share": ("n_upper", "n_ascii_letters", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "dup_line_share": ("n_dup_lines", "n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "repeat_word_share": ("n_repeat_words", "n_words", [0.25, 0.2, 0.15, 0.1]),
    "echo_share": ("n_echoes", "n_words", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "chars_per_word": ("word_chars", "n_words", [40, 30, 25, 20, 17, 15, 13, 12]),
}
_SPACE = C.lut(C.WHITESPACE)
_SYMBOL = C.lut(SYMBOLS)
_SHOUT = C.lut(b"!?")
_UPPER = C.lut(range(0x41, 0x5B))
_LETTER = C.lut([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def count_texts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of every text of a slice."""
    word = ~_SPACE[data]
    starts, ends = C.runs(word.view(np.int8), offs)
    first = np.searchsorted(starts, offs)                      # word offsets of the texts
    n_words = np.diff(first)
    span = C.SpanHash(data)

    # repeated windows: equal hashes inside one text; every word they cover counts once
    covered = np.zeros(len(starts) + 1, np.int64)
    words = span(starts, ends)
    text = np.repeat(np.arange(len(n_words)), n_words)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    h = C.windows(words, WINDOW)
    if len(h):
        at = np.flatnonzero(text[:len(h)] == text[WINDOW - 1:])
        key = C.mix(h[at] + (text[at].astype(C.U64) + C.U64(1)) * C.U64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0

    # lines with a word that equal an earlier line of the text
    line_no = (data == 0x0A).astype(np.int8)
    ls, le = C.runs((1 - line_no).view(np.int8), offs)
    text = np.searchsorted(offs, ls, "right") - 1
    worded = np.searchsorted(starts, le) > np.searchsorted(ends, ls, "right")
    ls, le, text = ls[worded], le[worded], text[worded]
    key = C.mix(span(ls, le) + (text.astype(C.U64) + C.U64(1)) * C.U64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    lines = np.searchsorted(text, np.arange(len(offs)))

    return [n_words, C.per_text(word & ((data & 0xC0) != 0x80), offs), C.per_text(_SYMBOL[data], offs),
            C.per_text(again, lines), C.per_text(covered, first), np.diff(lines),
            C.per_text(_SHOUT[data], offs), C.per_text(_UPPER[data], offs), C.per_text(_LETTER[data], offs), C.per_text(echo, first)]


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus one struct column of ``COUNTS``; a null text counts as empty."""
    return C.add_columns(docs, text, COUNTS, count_texts, "counts")


def base_failed(c):
    """Fewer than 20 words, or more than 30 % of the words in repeated windows."""
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def ratio(c, rule: str):
    num, den, _ = RULES[rule]
    return F.when(c[den] > 0, c[num] / c[den]).otherwise(F.lit(0.0))


def stratum_of(lang):
    return F.coalesce(lang.cast("string"), F.lit("und"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
             + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def enough(strata: int, risk: float, delta: float) -> int:
    """Good texts that a stratum must have for any cutoff to be certified, with no good text rejected."""
    return math.ceil(math.log(delta / max(1, strata * len(RULES))) / math.log1p(-risk / len(RULES)))


def choose(counts: dict[str, dict], risk: float, delta: float, strata: int | None = None) -> dict[str, dict[str, float]]:
    """Cutoffs per stratum from ``{stratum: {good, bad, (rule, i): (good hit, bad hit)}}``.

    ``strata`` is the number of strata tested, if more than those in ``counts``.
    """
    out: dict[str, dict[str, float]] = {}
    each = delta / max(1, (strata or len(counts)) * len(RULES))
    share = risk / len(RULES)
    for stratum, seen in counts.items():
        out[stratum] = {}
        for rule, (_, _, cutoffs) in RULES.items():
            best = 0
            for i, cutoff in enumerate(cutoffs):
                good, bad = seen[rule, i]
                if not seen["good"] or binomial_tail(good, seen["good"], share) > each:
                    break
                if bad - 5 * good > best:
                    best = bad - 5 * good
                    out[stratum][rule] = cutoff
    return out


def fit_cutoffs(docs: DataFrame, labels: DataFrame, risk: float = 0.04, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """Certified cutoffs ``{stratum: {rule: cutoff}}`` from every labelled text that passes the base.

    ``docs`` has doc_id, text, lang; ``labels`` has doc_id, quality (1 good, 0 bad; null ignored;
    of several labels of one id the largest counts).  Every stratum counts as tested, but only
    those with ``enough`` good texts can have a cutoff and reach the driver, one row each: a column of
    many stray languages costs nothing there and no stratum is left out.
    """
    lab = (labels.where("doc_id is not null and quality is not null")
           .groupBy(F.col("doc_id").alias("lab_id")).agg(F.max("quality").alias("lab_quality")))
    docs = docs.select(F.col("doc_id"), F.col("text"), stratum_of(F.col("lang")).alias("stratum"))
    counted, c = with_counts(docs)
    small = counted.select("doc_id", "stratum", c)
    seen = small.join(lab, small["doc_id"] == lab["lab_id"]).where(~base_failed(F.col(c)))
    good, bad = F.col("lab_quality") >= 1, F.col("lab_quality") < 1
    aggs = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    names = [(rule, i) for rule, (_, _, cuts) in RULES.items() for i in range(len(cuts))]
    for rule, i in names:
        hit = ratio(F.col(c), rule) >= RULES[rule][2][i]
        aggs += [F.count_if(hit & good).alias(f"g_{rule}_{i}"), F.count_if(hit & bad).alias(f"b_{rule}_{i}")]
    sums = materialize(seen.groupBy("stratum").agg(*aggs), "quality-strata")
    strata = sums.count()
    rows = sums.where(F.col("good") >= enough(strata, risk, delta)).collect()
    counts = {r["stratum"]: {"good": r["good"], "bad": r["bad"]}
              | {(rule, i): (r[f"g_{rule}_{i}"], r[f"b_{rule}_{i}"]) for rule, i in names} for r in rows}
    return choose(counts, risk, delta, strata)


def rejected(c, stratum, cutoffs: dict[str, dict[str, float]]):
    """True where a certified rule of the row's stratum rejects it."""
    out = F.lit(False)
    for rule in RULES:
        known = {s: v[rule] for s, v in cutoffs.items() if rule in v}
        if known:
            cut = F.create_map(*[x for s, v in known.items() for x in (F.lit(s), F.lit(float(v)))])
            out = out | F.coalesce(ratio(c, rule) >= F.try_element_at(cut, stratum), F.lit(False))
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.04, delta: float = 0.05) -> tuple[DataFrame, str]:
    """``docs`` plus a struct column (``COUNTS``, base_failed, kept); returns its name too.

    Needs the columns doc_id, text, lang.  Null and empty texts have no words and fail the base.
    Repeated rows are judged each; extra columns pass through.  Without labels only the base holds.
    """
    cutoffs = fit_cutoffs(docs, labels, risk, delta)
    counted, c = with_counts(docs)
    fail = base_failed(F.col(c))
    verdict = C.unused(counted, "verdict")
    keep = ~fail & ~rejected(F.col(c), stratum_of(F.col("lang")), cutoffs)
    return counted.withColumn(verdict, F.struct(F.col(f"{c}.*"), fail.alias("base_failed"), keep.alias("kept"))).drop(c), verdict
