"""Augmentation: alias lexicon (S04), entity replacement (G01/J05), bracket perturbation
(G02), augmented set (G03).

All row-local and linear: mentions come from the span function (T14), the new text and
labels are assembled from the gaps between mentions with ``transform`` over the mention
array, so long texts cost one pass.  The alias pool is the fixed 150-value lexicon (a
proven size), carried as a literal array; the pick per mention is
``md5(seed:id:mention) mod 150``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.constants import SEED, bank_lexicon_rows
from tagloom.functions import bio
from tagloom.operators import sampling as sp
from tagloom.session import materialize


WORD_PIECES = r"[A-Za-z]+|[\x{4e00}-\x{9fff}]{1,2}|[^A-Za-z\x{4e00}-\x{9fff}]+"


def lexicon_wide(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bank_lexicon_rows(), "bank string, cn string, en string")


def lexicon_long(wide: DataFrame) -> DataFrame:
    """Wide (bank, cn, en) -> long (kind, alias); duplicates kept (they weigh double)."""
    return wide.unpivot([], ["bank", "cn", "en"], "kind", "alias").filter(F.col("alias").isNotNull())


def alias_pool() -> list[str]:
    """The stacked aliases in row order (bank, cn, en of row 1, then row 2, ...)."""
    return [a for row in bank_lexicon_rows() for a in row]


def _pick(key: Column, k: Column, n: int, seed: int) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), k.cast("string")))
    return F.pmod(sp.hash_int(h), F.lit(n)).cast("int")


def _uniform(key: Column, k: Column, seed: int) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}:p:"), key.cast("string"), F.lit(":"), k.cast("string")))
    return sp.hash_int(h) / F.lit(float(1 << 60))


def with_entity_replaced(df: DataFrame, key: str = "id", text: str = "text", labels: str = "labels",
                         p: float = 1.0, seed: int = SEED, kind: str = "BANK", choose=None) -> DataFrame:
    """Replace each ``kind`` mention by an alias drawn per mention.

    With probability ``p`` a mention (``B-X`` plus its ``I-X`` run) becomes the alias with
    labels ``B-X`` + ``I-X`` x (len-1) (D1/D2: labels always fit the new length); other
    characters and labels are copied.  Output columns ``new_text``, ``new_labels``.

    F01: ``choose(mention, n)`` gives the replacement of the mention's text (n counts from 1) as a
    column, for example another pool's pick; the default draws from the fixed lexicon.
    """
    pool = F.array(*[F.lit(a) for a in alias_pool()])
    d = bio.with_spans(df, labels, "__sp")
    d = d.withColumn("__m", F.filter("__sp", lambda s: s["kind"] == kind))
    m, lab, txt, k = F.col("__m"), F.col(labels), F.col(text), F.col(key)
    n = F.size(lab)

    def piece(s, g):
        prev_end = F.when(g == 0, F.lit(0)).otherwise(F.element_at(m, g)["end"])
        gap_t = F.substring(txt, prev_end + 1, s["start"] - prev_end)
        gap_l = F.slice(lab, prev_end + 1, s["start"] - prev_end)
        take = _uniform(k, g + 1, seed) < F.lit(p)
        old_t = F.substring(txt, s["start"] + 1, s["end"] - s["start"])
        alias = choose(old_t, g + 1) if choose else F.element_at(pool, _pick(k, g + 1, len(alias_pool()), seed) + 1)
        old_l = F.slice(lab, s["start"] + 1, s["end"] - s["start"])
        new_l = F.concat(F.array(F.lit(f"B-{kind}")), F.array_repeat(F.lit(f"I-{kind}"), F.length(alias) - 1))
        return F.struct(F.concat(gap_t, F.when(take, alias).otherwise(old_t)).alias("t"),
                        F.concat(gap_l, F.when(take, new_l).otherwise(old_l)).alias("l"))

    pieces = bio._pinned(m, F.transform(m, piece))
    last_end = F.coalesce(F.try_element_at(m, F.lit(-1))["end"], F.lit(0))
    d = d.withColumn("__pc", F.when(F.size(m) > 0, pieces).otherwise(F.array()))
    tail_t = F.substring(txt, last_end + 1, F.length(txt))
    tail_l = F.slice(lab, last_end + 1, F.greatest(n - last_end, F.lit(0)))
    new_t = F.concat(F.array_join(F.transform("__pc", lambda x: x["t"]), ""),
                     F.when(last_end < F.length(txt), tail_t).otherwise(F.lit("")))
    new_l = F.concat(F.flatten(F.transform("__pc", lambda x: x["l"])),
                     F.when(last_end < n, tail_l).otherwise(bio.empty_strings()))
    return d.withColumn("new_text", new_t).withColumn("new_labels", new_l).drop("__sp", "__m", "__pc")


def with_lexicon_replaced(df: DataFrame, lexicon: DataFrame, order: list[str], alias: str = "alias", key: str = "id", text: str = "text",
                          labels: str = "labels", p: float = 1.0, seed: int = SEED, kind: str = "BANK") -> DataFrame:
    """G01 with the aliases of a table (J05): as ``with_entity_replaced``, for a lexicon of any size.

    The lexicon's rows are numbered in the order of ``order``; an alias that occurs twice weighs double,
    a null alias takes no part.  Each mention picks a number, the picks are joined with the numbered lexicon
    (AQE splits a hot one), and a text's aliases are put back in the order of its mentions.  Mentions stay
    as they are where the key is null or the lexicon empty.
    """
    columns = df.columns
    index = sp.dense_index(lexicon.where(F.col(alias).isNotNull()).select(*dict.fromkeys([*order, alias])), order, out="__idx")
    n = index.count()
    if n == 0:
        return with_entity_replaced(df, key, text, labels, p, seed, kind, choose=lambda mention, k: mention)
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    spans = bio.with_spans(rows.where(F.col(key).isNotNull()).select("__row", F.col(key).alias("__key"), labels), labels, "__sp")
    mentions = F.filter("__sp", lambda s: s["kind"] == kind)
    each = spans.select("__row", "__key", F.posexplode_outer(mentions).alias("__k", "__m")).where(F.col("__m").isNotNull())
    picks = each.select("__row", "__k", _pick(F.col("__key"), F.col("__k") + 1, n, seed).cast("long").alias("__pick"))
    got = (picks.join(index.select("__idx", F.col(alias).alias("__a")), F.col("__pick") == F.col("__idx"))
           .groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__k", "__a"))).alias("__got")))
    named = rows.join(got, "__row", "left").withColumn("__alias", F.transform("__got", lambda x: x["__a"]))
    out = with_entity_replaced(named, key, text, labels, p, seed, kind, choose=lambda mention, k: F.get("__alias", k - 1))
    return out.select(*columns, "new_text", "new_labels")


def with_brackets(df: DataFrame, key: str = "id", text: str = "text", labels: str = "labels",
                  p: float = 0.1, seed: int = SEED) -> DataFrame:
    """Each word becomes ``<word>`` with probability p; the two added characters repeat
    the word's last label (appended after the word's labels).  A word is an ASCII letter run or,
    in text without blanks between words, one or two Han characters."""
    d = df.withColumn("__pcs", F.regexp_extract_all(F.col(text), F.lit(WORD_PIECES), 0))
    d = d.withColumn("__off", bio.exclusive_prefix(F.transform("__pcs", lambda x: F.length(x))))
    z = F.arrays_zip(F.col("__pcs").alias("w"), F.col("__off").alias("o"))
    lab, k = F.col(labels), F.col(key)

    def one(e, g):
        w, o = e["w"], e["o"]
        wl = F.slice(lab, o + 1, F.length(w))
        hit = w.rlike(r"^[A-Za-z\x{4e00}-\x{9fff}]") & (_uniform(k, g + 1, seed + 7) < F.lit(p))
        return F.struct(F.when(hit, F.concat(F.lit("<"), w, F.lit(">"))).otherwise(w).alias("t"),
                        F.when(hit, F.concat(wl, F.array_repeat(F.element_at(wl, -1), 2))).otherwise(wl).alias("l"))

    d = d.withColumn("__pc", bio._pinned(lab, F.transform(z, one)))
    return (d.withColumn("new_text", F.array_join(F.transform("__pc", lambda x: x["t"]), ""))
            .withColumn("new_labels", F.flatten(F.transform("__pc", lambda x: x["l"])))
            .drop("__pcs", "__off", "__pc"))
