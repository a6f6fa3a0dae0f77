"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Base spans: leftmost non-overlapping matches of four patterns (email, ip, card, phone), checked
   for ranges, checksum and digit counts.  They always stay.
2. Candidates: looser spans (spelled-out addresses, number-shaped groups of 7 to 19 digits) outside them.
3. Labelers vote +1, 0 or -1 on every span: shapes (regex), word lists (gazetteer) and the words
   before it (context).
4. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
   is, with the base spans as known positives; it gives every pattern a probability.
5. A logistic regression on span features learns those probabilities, so the verdict does not need
   any labeler to have voted; candidates that reach ``accept`` are added.

The main path is DataFrame expressions only, row by row: a text never leaves its row and only
span tables are shuffled, combined by pattern first.  The driver sees at most one row per vote and
feature pattern (3^4 x 5 x 3 x 2^2, whatever the data).

Positions are code points, end exclusive.  They come from the lengths of the pieces between the
matches (``split``) and of the matches, by running sums in blocks (``running``), linear in the text.
All base patterns are possessive and anchored at run starts, so they are linear and never recurse, and
match what the plain forms match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: a match may begin at a run's start or where the last match ended (in the same run)
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPELLED = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: (?:dot|punkt|punto|point) [A-Za-z0-9_%+-]++)*+ ?(?:\(at\)|\[at\]|\{at\}|<at>) ?"
           r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\.) ?[A-Za-z0-9-]++| dot [A-Za-z0-9-]++)++")
#: a number begins where no word, address or number goes on; shapes that hold blanks come first, so that
#: numbers beside each other stay apart
NUMBERS = (r"(?<![A-Za-z0-9_.@/-])(?:"
           r"(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"            # area, exchange, line
           r"|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?(?![0-9])"                     # cards in fours
           r"|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])"                                     # cards of 15 digits
           r"|\(?0[0-9]{1,4}\)?[\x20/][0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,3}(?![0-9])"               # trunk prefix and groups
           r"|\(?[0-9]++\)?+(?:[./()-]{1,2}[0-9]++)*+"
           r")(?![A-Za-z0-9_@])")
CONTEXT = 24
BLOCK = 32
ACCEPT = 0.9

#: words before a span that speak for or against personal data
FOR_WORDS = (r"(?i)(?:tel|phone|telephone|call|fax|mobile|cell|contact|mail|email|write to|reach|card|visa|mastercard|amex|ssn|security|iban|"
             r"kontakt|anruf|telefon|handy|rufnummer|téléphone|appel|portable|llama|llame|teléfono|móvil|correo|kredit|tarjeta|carte)"
             r"[^A-Za-z0-9]{0,4}$")
AGAINST_WORDS = (r"(?i)(?:page|pages|version|isbn|issn|doi|id|no|nr|token|key|password|year|total|build|serial|order|invoice|ticket|commit|row|"
                 r"seite|jahr|página|año|página|rechnung|facture|pedido|numéro)[^A-Za-z0-9]{0,4}$")
#: gazetteer of mail ends (besides every two-letter country end) and mail providers
MAIL_ENDS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi",
             "travel", "tel", "cat", "asia", "post", "xyz", "online", "site", "store", "app", "dev", "cloud", "email", "tech", "blog")
PROVIDERS = ("gmail", "googlemail", "yahoo", "ymail", "hotmail", "outlook", "live", "msn", "icloud", "me", "mac", "aol", "gmx", "web",
             "proton", "protonmail", "fastmail", "zoho", "mail", "yandex", "qq", "163", "126", "orange", "wanadoo", "free", "laposte",
             "libero", "t-online", "freenet", "comcast", "verizon", "att")
#: numbers that belong to nobody (toll-free codes), and the first digits of card issuers
TOLL_FREE = ("800", "888", "877", "866", "855", "844", "833", "822", "900")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|35|6011|62|64|65)"


# --- running values ----------------------------------------------------------------------

def running(df: DataFrame, values: str, out: str, combine, zero) -> DataFrame:
    """``df`` plus ``out``: the values of an array column combined up to and with each position.

    In blocks of ``BLOCK``, whose totals are combined in the same way; the totals of the third level, one
    for ``BLOCK``^3 values, are few.  Linear, as the arrays are columns: each is computed once, and the
    lambdas only slice it (the size asked beside them keeps the optimiser from moving it into them).
    """
    zero = F.lit(zero).cast("long")
    fold = lambda x: F.aggregate(x, zero, combine)
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    levels, names = [values], []

    def held(name, arr, made):
        nonlocal df
        df = df.withColumn(name, F.when(F.size(arr) >= 0, made))
        names.append(name)
        return name

    def blocks(arr):
        return steps(F.ceil(F.size(arr) / BLOCK).cast("int"))

    def part(arr, b):
        return F.slice(arr, b * BLOCK + 1, F.lit(BLOCK))

    def totals(arr):
        return F.transform(blocks(arr), lambda b: fold(part(arr, b)))

    def within(arr, up, through):
        """Each block's values combined, after what came before the block."""
        def block(b):
            here = part(arr, b)
            return F.transform(here, lambda _, j: combine(F.get(up, b), fold(F.slice(here, F.lit(1), j + 1 if through else j))))
        return F.when(F.size(up) >= 0, F.flatten(F.transform(blocks(arr), block)))

    for i in range(3):
        levels.append(held(f"{out}_up{i}", levels[-1], totals(levels[-1])))
    top = levels[-1]
    before = held(f"{out}_top", top, F.transform(steps(F.size(top)), lambda i: fold(F.slice(top, F.lit(1), i))))
    for i in (2, 1, 0):
        before = held(f"{out}_down{i}", levels[i], within(levels[i], before, i == 0))
    return df.withColumn(out, F.col(before)).drop(*names)


# --- spans -------------------------------------------------------------------------------

def add_matches(df: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` (with column text) plus, for each name, an array of (s, e, m, before), empty without matches.

    ``patterns`` is name -> (pattern, guard); ``before`` holds the last ``CONTEXT`` characters ahead of the
    match.  A start is the running length of the pieces between the matches and of the matches.
    """
    none = F.array().cast("array<string>")
    for name, (pattern, guard) in patterns.items():
        df = df.withColumn(f"{name}_m", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(none))
        df = df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split("text", pattern, -1)).otherwise(none))
        df = df.withColumn(f"{name}_g", F.slice(f"{name}_g", F.lit(1), F.size(f"{name}_m")))
    lengths = [F.zip_with(f"{n}_g", f"{n}_m", lambda g, m: (F.length(g) + F.length(m)).cast("long")) for n in patterns]
    df = running(df.withColumn("_steps", F.concat(*lengths)), "_steps", "_ends", lambda a, b: a + b, 0)
    first = F.lit(0)
    for name in patterns:
        size = F.size(f"{name}_m")
        before = F.coalesce(F.get("_ends", first - 1), F.lit(0).cast("long"))
        rows = placed(F.slice("_ends", first + 1, size), before, f"{name}_m", f"{name}_g")
        df = df.withColumn(name, F.when(F.size("_ends") >= 0, rows))
        first = first + size
    return df.drop("_steps", "_ends", *[f"{n}_{x}" for n in patterns for x in "mg"])


def placed(ends: Column, origin: Column, matches: str, gaps: str) -> Column:
    pieces = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.right(g, F.lit(CONTEXT)).alias("g")))
    return F.zip_with(ends, pieces, lambda e, x: F.struct((e - origin - F.length(x["m"])).alias("s"), (e - origin).alias("e"),
                                                          x["m"].alias("m"), x["g"].alias("before")))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Checksum of a digit string of at most 19 digits."""
    back = F.reverse(d)
    value = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    odd = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + odd(i)) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":                                               # at most 255 each, whatever zeros stand before
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def all_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) plus ``base``, by kind then start, and ``cand``: arrays of (k, s, e, m, before).

    Candidates are numbers of 7 to 19 digits and spelled-out addresses that share no character with a
    base span, found by one pass over both in the order of their places.
    """
    text = F.col("text")
    numbers = text.rlike("[0-9]")
    at = text.rlike(r"[(\[{<]at[)\]}>]")
    docs = add_matches(docs, {"_email": (PATTERNS["email"], F.contains("text", F.lit("@"))), "_ip": (PATTERNS["ip"], numbers),
                              "_card": (PATTERNS["card"], numbers), "_phone": (PATTERNS["phone"], F.contains("text", F.lit("+"))),
                              "_spelled": (SPELLED, at), "_number": (NUMBERS, numbers)})

    def span(k, x):
        return F.struct(k.alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"))

    def checked(n, kind):
        return F.transform(F.filter(F.col(f"_{kind}"), lambda x: holds(kind, x["m"])), lambda x: span(F.lit(n), x))

    base = [checked(n, kind) for n, kind in enumerate(KINDS)]
    counted = F.transform("_number", lambda x: F.struct(x.alias("x"), F.length(digits(x["m"])).alias("n")))
    found = F.concat(F.transform("_spelled", lambda x: span(F.lit(0), x)),
                     F.transform(F.filter(counted, lambda x: x["n"].between(7, 19)),
                                 lambda x: span(F.when(x["n"] >= 13, 2).otherwise(3), x["x"])))
    docs = docs.withColumn("base", F.concat(*base)).withColumn("_found", found)
    # a candidate is met by a base span if one that starts before its end ends after its start
    events = F.sort_array(F.concat(
        F.transform("base", lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("side"), b["e"].alias("until"), F.lit(-1).alias("i"))),
        F.transform("_found", lambda c, i: F.struct(c["e"].alias("at"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("until"), i.alias("i")))))
    docs = docs.withColumn("_events", events).withColumn("_until", F.transform("_events", lambda v: v["until"]))
    docs = running(docs, "_until", "_reach", lambda a, b: F.greatest(a, b), 0)
    met = F.zip_with("_events", "_reach", lambda v, r: F.struct(v["i"].alias("i"), r.alias("r")))
    free = F.filter(F.transform(F.filter(met, lambda v: v["i"] >= 0), lambda v: F.struct(F.get("_found", v["i"]).alias("c"), v["r"].alias("r"))),
                    lambda v: v["r"] <= v["c"]["s"])
    cand = F.when(F.size("_found") >= 0, F.transform(free, lambda v: v["c"]))
    return docs.withColumn("cand", cand).drop("_found", "_events", "_until", "_reach", *[f"_{k}" for k in (*KINDS, "spelled", "number")])


# --- candidates, votes and features ------------------------------------------------------

VOTES = ("shape", "checksum", "gazetteer", "context")
FEATURES = ("size", "form", "opens", "cued")


def described(spans: Column) -> Column:
    """Spans with the labelers' votes and the classifier's features (small integers)."""
    found = F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"),
                                                  digits(x["m"]).alias("d"), x["m"].rlike(r"[A-Za-z@]").alias("name")))
    return F.transform(found, judged)


def judged(x: Column) -> Column:
    m, d, name = x["m"], x["d"], x["name"]
    n = F.length(d)
    shape = (F.when(name, 1)
             .when(m.rlike(r"^(?:\+?1[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\+[0-9]|^\(?0[0-9]{1,4}\)?[\x20/]"
                           r"|^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$"), 1)
             .when(m.rlike(r"^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|^[0-9]+\.[0-9]+$|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$|^97[89]-"), -1).otherwise(0))
    long = F.when(n.between(13, 19), d).otherwise(F.lit("0"))
    checksum = F.when(name | ~n.between(13, 19), 0).when(luhn(long), 1).otherwise(-1)
    end = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))
    area = F.regexp_replace(d, "^1(?=[0-9]{10}$)", "")
    gazetteer = (F.when(name, F.when(end.isin(*MAIL_ENDS) | end.rlike("^[a-z]{2}$") | m.rlike(r"(?i)[@)\]}> ](?:" + "|".join(PROVIDERS) + r")[ .(\[{<]"), 1).otherwise(-1))
                 .when(n.between(13, 19), F.when(d.rlike(ISSUERS), 1).otherwise(-1))
                 .when(n.between(10, 11) & F.substring(area, 1, 3).isin(*TOLL_FREE), -1)
                 .when(n.between(10, 11) & area.rlike("^[2-9][0-8][0-9][2-9][0-9]{6}$") & ~area.rlike("^[2-9]11|^...[2-9]11"), 1)
                 .when((n == 9) & m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(d.rlike("^(?:000|666|9|...00|.....0000)"), -1).otherwise(1)).otherwise(0))
    context = F.when(x["before"].rlike(FOR_WORDS), 1).when(x["before"].rlike(AGAINST_WORDS), -1).otherwise(0)
    size = F.when(name, 0).when(n < 8, 1).when(n < 12, 2).when(n < 16, 3).otherwise(4)
    form = F.when(m.rlike(r"^[0-9]+$"), 0).when(m.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,4})+$"), 1).otherwise(2)
    return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"),
                    shape.alias("shape"), checksum.alias("checksum"), gazetteer.alias("gazetteer"), context.alias("context"),
                    size.alias("size"), form.alias("form"), m.rlike(r"^[(+]").cast("int").alias("opens"),
                    (context != 0).cast("int").alias("cued"))


def span_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, base, cand) without the texts, written to the shared folder: all later steps read this."""
    docs = C.text_rows(docs).withColumn("text", F.coalesce("text", F.lit("")))
    docs = all_spans(docs)
    return materialize(docs.select("doc_id", described(F.col("base")).alias("base"), described(F.col("cand")).alias("cand")), "pii-spans")


# --- EM over vote patterns, classifier over feature patterns -----------------------------

def reliabilities(counts: list[tuple[tuple[int, ...], bool, float]], rounds: int = 50) -> dict:
    """Dawid-Skene EM with two classes over (votes, known positive, count).

    Known positives stay at probability 1.  Returns the prior and, per labeler and class, the
    probabilities of the votes -1, 0, 1; they start better than chance and are smoothed.
    """
    def start(votes, known):
        return 1.0 if known else min(0.95, max(0.05, 0.4 + 0.25 * sum(votes)))

    post = [start(v, known) for v, known, _ in counts]
    model: dict = {}
    for _ in range(rounds):
        open_ = [(p, n) for p, (_, known, n) in zip(post, counts) if not known]
        model = {"prior": (sum(p * n for p, n in open_) + 1) / (sum(n for _, n in open_) + 2), "vote": []}
        for j in range(len(VOTES)):
            table = []
            for cls in (0, 1):
                mass = {-1: 2.0 - cls, 0: 2.0, 1: 1.0 + cls}      # pseudo-counts: a vote rather tells the truth
                for p, (v, _, n) in zip(post, counts):
                    mass[v[j]] += n * (p if cls else 1 - p)
                total = sum(mass.values())
                table.append({k: m / total for k, m in mass.items()})
            model["vote"].append(table)
        post = [1.0 if known else posterior(model, v) for v, known, _ in counts]
    return model


def posterior(model: dict, votes: tuple[int, ...]) -> float:
    z = math.log(model["prior"]) - math.log(1 - model["prior"])
    for j, v in enumerate(votes):
        no, yes = model["vote"][j]
        if v:                                                     # an abstention says nothing
            z += math.log(yes[v] / (yes[-1] + yes[1])) - math.log(no[v] / (no[-1] + no[1]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def classifier(rows: list[tuple[tuple[int, ...], tuple[int, ...], float, float]], rounds: int = 300) -> dict:
    """Logistic regression on one-hot features and votes from (features, votes, target, count)."""
    weights: dict = {("bias", 0): 0.0}
    coded = []
    for feats, votes, y, n in rows:
        on = [("bias", 0), *zip(FEATURES, feats), *zip(VOTES, votes)]
        for f in on:
            weights.setdefault(f, 0.0)
        coded.append((on, y, n))
    total = sum(n for *_, n in coded) or 1.0
    for _ in range(rounds):
        grad = {f: 0.002 * w for f, w in weights.items()}
        for on, y, n in coded:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in on)))))
            for f in on:
                grad[f] += (p - y) * n / total
        for f, g in grad.items():
            weights[f] -= 1.0 * g
    return weights


def fit(spans: DataFrame) -> dict:
    """Classifier weights from all base and candidate spans of ``span_rows``."""
    one = lambda col, known: spans.select(F.explode(col).alias("x")).select(
        *[F.col("x")[f].alias(f) for f in (*VOTES, *FEATURES)], F.lit(known).alias("known"))
    counts = (one("base", True).union(one("cand", False)).groupBy(*VOTES, *FEATURES, "known").agg(F.count("*").alias("n")).collect())
    if not counts:
        return {("bias", 0): -10.0}
    by: dict = {}
    for r in counts:
        key = (tuple(r[v] for v in VOTES), r["known"])
        by[key] = by.get(key, 0) + r["n"]
    model = reliabilities([(v, known, float(n)) for (v, known), n in sorted(by.items())])
    return classifier([(tuple(r[f] for f in FEATURES), tuple(r[v] for v in VOTES),
                        1.0 if r["known"] else posterior(model, tuple(r[v] for v in VOTES)), float(r["n"]))
                       for r in sorted(counts, key=tuple)])


def probability(x: Column, weights: dict) -> Column:
    z = F.lit(weights.get(("bias", 0), 0.0))
    for name in (*FEATURES, *VOTES):
        known = {v: w for (f, v), w in weights.items() if f == name}
        if known:
            table = F.create_map(*[c for v, w in sorted(known.items()) for c in (F.lit(v), F.lit(w))])
            z = z + F.coalesce(F.try_element_at(table, x[name]), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, base, spans): arrays of (k, s, e) with the kind's number, by kind then start.

    One row per row of ``docs`` (doc_id, text): null and empty texts have empty arrays, repeated
    rows and null ids are no special case.  ``spans`` holds the base and the accepted candidates.
    """
    rows = span_rows(docs)
    weights = fit(rows)
    bare = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    added = F.filter("cand", lambda x: probability(x, weights) >= accept)
    return rows.select("doc_id", F.transform("base", bare).alias("base"),
                       F.sort_array(F.transform(F.concat("base", added), bare)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
