"""Mixing sources to target weights with soft domain membership.

A labelled table teaches a word classifier the domains; every document then has posteriors
``p[d, k]`` and belongs to every domain a little.  Wanted are document rates ``r[d] >= 0`` (how
often a document is used per epoch) whose expected domain token totals match the targets:

    minimise  1/2 * e' M e   over r >= 0,   e[k] = sum_d r[d] q[d, k] - w[k]

with ``q[d, k] = n[d] p[d, k] / N``, ``n[d]`` the tokens of a document, ``N`` of all, ``w`` the target
shares.  From rates of 1, projected gradient steps

    r[d] <- max(0, r[d] - length * D * sum_k q[d, k] (M e)[k])

are taken until all shares are within the tolerance of their targets.  ``M`` is the inverse of the
domains' K x K Gram matrix ``D * q' q`` over the documents whose rate is not zero: with it a step of
length 1 meets the targets but for what the projection cuts off, and a few very long documents, once
at zero, no longer decide how much a miss weighs.  A step that does not bring the shares nearer is
halved.  The rates are a function of a document's ``q`` and the steps so far, so a step is one pass
that sums K shares and the Gram matrix, and nothing is written for it.

The classifier is multinomial naive Bayes over hashed words, counted over the sampled labelled texts
with smoothing.  Its ``BUCKETS`` x K ratios, of fixed size, stand in the plan as constants, so a text
is scored in its row and never shuffled.  Everything on the main path is DataFrame expressions (numpy
solves the K x K systems on the driver).
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.session import materialize

BUCKETS = 1 << 14
GAP = 1e-4                      # a share may miss its target by so much
REST = "other"                  # the domain of all labels without a target


def words(text: Column) -> Column:
    """Pieces between blanks, lower-cased; a text without any gives one empty piece."""
    return F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))), r"[\x20\x09-\x0D]+")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def constants(values) -> Column:
    """An array of doubles in the plan."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


# --- domain classifier -------------------------------------------------------------------

def word_model(docs: DataFrame, labelled: DataFrame, per_domain: int = 3000) -> tuple[list[str], np.ndarray]:
    """(domains, log-likelihood ratios, one row per bucket) from the labelled table.

    ``labelled`` is (doc_id, label); about ``per_domain`` texts of each label are counted.  The
    ratios are against the mean of the domains, so an unknown word says nothing.  At most as many
    labels as the caller has targets, and one for the rest.
    """
    sample, shares = C.sample_by_class(docs, labelled, per_domain, bound=None)
    domains = sorted(shares)
    if not domains:
        return [], np.zeros((BUCKETS, 0))
    each = sample.select("doc_id", "label", F.explode(words(F.col("text"))).alias("word")).where("word <> ''")
    each = each.select("doc_id", "label", bucket(F.col("word")).alias("bucket")).distinct()
    rows = each.groupBy("bucket").agg(*[F.count_if(F.col("label") == k).alias(f"c{i}") for i, k in enumerate(domains)]).collect()
    counts = np.zeros((BUCKETS, len(domains)))
    for r in rows:                                                # at most BUCKETS rows
        counts[r["bucket"]] = r[1:]
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    logs[counts.sum(1) == 0] = 0.0
    return domains, logs - logs.mean(1, keepdims=True)


def posteriors(docs: DataFrame, domains: list[str], model: np.ndarray, n: str = "n_tokens", p: str = "p") -> DataFrame:
    """``docs`` plus the token count ``n`` and an array ``p`` of domain posteriors.

    The evidence of a text is its summed ratios over the square root of its word count, which keeps
    long texts from certainty.  Without words (null, empty), or a model, all domains are equal.
    Row by row: nothing is shuffled, and null or repeated ids are no special case.
    """
    keep = docs.columns
    at, z, e = (C.unused(docs, c) for c in ("mix_at", "mix_z", "mix_e"))
    size = F.when(F.get(at, F.lit(0)) == "", 0).otherwise(F.size(at)).cast("long")
    rows = docs.withColumn(at, words(F.col("text"))).withColumn(n, size)
    if not domains:
        return rows.select(*keep, n, F.array(F.lit(1.0)).alias(p))
    rows = rows.withColumn(at, F.transform(at, bucket))

    def score(i: int) -> Column:                                  # only differences to the first domain count
        table = constants(model[:, i] - model[:, 0])
        return F.when(F.col(n) > 0, F.aggregate(at, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.sqrt(F.col(n))).otherwise(0.0)

    rows = rows.select(*keep, n, F.array(F.lit(0.0), *[score(i) for i in range(1, len(domains))]).alias(z))
    rows = rows.select(*keep, n, F.transform(z, lambda x: F.exp(x - F.array_max(z))).alias(e))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return rows.select(*keep, n, F.transform(e, lambda x: x / total).alias(p))


# --- rates -------------------------------------------------------------------------------

def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a K x K system, scaled so that rare domains count like frequent ones."""
    scale = 1 / np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    return scale * np.linalg.lstsq(matrix * scale[:, None] * scale, right * scale, rcond=1e-13)[0]


def rate_after(steps: list[np.ndarray], q: list[Column]) -> Column:
    """A document's rate after projected gradient steps ``r <- max(0, r - q' c)`` from 1."""
    if not steps:
        return F.lit(1.0)
    k, c = len(q), constants(np.concatenate(steps))

    def step(r: Column, t: Column) -> Column:
        move = sum((q[i] * F.get(c, t * k + i) for i in range(k)), F.lit(0.0))
        return F.greatest(F.lit(0.0), r - move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), step)


def fit_rates(member: DataFrame, targets: list[float], tolerance: float = GAP, passes: int = 100, patience: int = 6,
              n: str = "n_tokens", p: str = "p", rate: str = "rate") -> tuple[DataFrame, list[float]]:
    """``member`` (.., n, p) plus ``rate``, and the domain shares that the rates give.

    Stops when all shares are within ``tolerance`` of the targets, when ``patience`` passes bring the
    largest miss down by less than 1 % (the targets cannot be met), or after ``passes`` passes.
    Documents without tokens have rate 1.  With all documents empty every rate is 1.
    """
    k = len(targets)
    size = member.agg(F.sum(n).alias("n"), F.count("*").alias("d")).first()
    total, d = float(size["n"] or 0), float(size["d"] or 0)
    if not total:
        return member.withColumn(rate, F.lit(1.0)), [0.0] * k
    w = np.array(targets, float)
    q = [F.col(n) * F.col(p)[i] / total for i in range(k)]          # share of domain i per unit rate

    def look(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The shares, and the Gram matrix of the documents with a rate: one pass over all documents."""
        held, r = [F.col(f"q{i}") for i in range(k)], F.col("r")
        row = member.select(rate_after(steps, q).alias("r"), *[x.alias(f"q{i}") for i, x in enumerate(q)]).where(r > 0).agg(
            *[F.sum(r * held[i]).alias(f"s{i}") for i in range(k)],
            *[F.sum(held[i] * held[j] * d).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), gram

    steps: list[np.ndarray] = []
    shares, gram = look(steps)
    done, length, history = 1, 1.0, [float(np.abs(shares - w).max())]
    while history[-1] > tolerance and done < passes and not (
            len(history) > patience and history[-1] > 0.99 * history[-1 - patience]):
        miss = shares - w
        weighed = solve(gram, miss)                               # M e, the gradient in the domains
        while True:
            step = length * d * weighed
            new, new_gram = look([*steps, step])
            done += 1
            nearer = (new - w) @ solve(gram, new - w) < miss @ weighed
            if nearer or done >= passes or length < 1e-6:
                break
            length /= 2
        if not nearer:
            break
        steps, shares, gram, length = [*steps, step], new, new_gram, min(1.0, 2 * length)
        history.append(float(np.abs(shares - w).max()))
    return member.withColumn(rate, rate_after(steps, q)), shares.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = 3000, keep_text: bool = True) -> DataFrame:
    """``docs`` plus n_tokens, p (posteriors, domains in name order) and rate.

    ``docs`` is (doc_id, text, ..), ``labelled`` (doc_id, label).  Targets are shares of tokens by
    domain; they are scaled to sum 1 over the domains that the labelled table has.  Labels without a
    target are one domain (``REST``) of share 0.  Without any labelled text there is one domain and all
    rates are 1.  Null and empty texts have equal posteriors, no tokens and rate 1; repeated rows and
    null ids are rows like others; an empty table gives none.  Where ``docs`` has columns of those names
    the new ones end in an underscore.  The rate has the domains' targets, the shares that the rates
    give and the largest gap between them as metadata; a gap above ``GAP`` is also warned of.

    The scored documents are written once (without text if ``keep_text`` is false); the passes of the
    fit read their counts and posteriors alone, and the result is that table with one column more.
    """
    n, p, rate = (C.unused(docs, c) for c in ("n_tokens", "p", "rate"))
    known = F.col("label").isin(*targets) if targets else F.lit(False)
    labelled = labelled.select("doc_id", F.when(known, F.col("label")).when(F.col("label").isNotNull(), REST).alias("label"))
    domains, model = word_model(C.text_rows(docs), labelled, per_domain)
    texts = docs.withColumn("text", F.col("text").cast("string"))
    scored = posteriors(texts, domains, model, n, p)
    member = materialize(scored if keep_text else scored.drop("text"), "mixing-members")
    wanted = [max(0.0, targets.get(k, 0.0)) for k in domains]
    if not sum(wanted):
        return member.withColumn(rate, F.lit(1.0))
    wanted = [x / sum(wanted) for x in wanted]
    rated, shares = fit_rates(member, wanted, n=n, p=p, rate=rate)
    gap = max(abs(a - b) for a, b in zip(shares, wanted)) if any(shares) else 0.0
    if gap > GAP:
        warnings.warn(f"rates miss the target shares by up to {gap:.2g}: "
                      + ", ".join(f"{k} {a:.4f} of {b:.4f}" for k, a, b in zip(domains, shares, wanted)), stacklevel=2)
    told = {"targets": dict(zip(domains, wanted)), "shares": dict(zip(domains, shares)), "gap": gap}
    return rated.withColumn(rate, F.col(rate).alias(rate, metadata=told))
