"""The registered query of every operator: op<N>_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm import (bpe, decontaminate, hard_negatives, language_id, line_dedup, mixing, pii, quality_classifier, quality_rules,
                         ranked_search, simhash, toxicity, warc)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``, by ``pii.find``: counts and digest of the base spans, all spans.

    One row per document row; a null text is empty; repeated rows and null ids are rows like others.
    """
    found = pii.find(C.table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


#: token shares of the domains that the labelled table has
TARGETS = {"good": 0.92, "low": 0.06, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, else good or low quality."""
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", label.alias("label"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rates of ``documents`` that meet ``TARGETS``, by ``mixing.mix``; without the texts.

    One row per document row; null and empty texts have rate 1; without labels all rates are 1.
    """
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, domains(C.table(spark, sf_dir, "labels")), TARGETS, keep_text=False)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in every whole text of ``documents``, by ``decontaminate.find``.

    One row per document row; a null text has no words; null items match nothing, null item ids are not listed.
    """
    docs = C.text_rows(C.table(spark, sf_dir, "documents"))
    found, leak = decontaminate.find(docs, C.table(spark, sf_dir, "benchmark"))
    leak = F.col(leak)
    return found.select("doc_id", leak["n_words"].alias("n_words"), leak["n_hit"].alias("n_hit"),
                        F.size(leak["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
                        decontaminate.contaminated(leak).alias("contaminated"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and verdict of every whole text of ``documents``, by ``quality_rules.judge``.

    One row per document row; null and empty texts fail the base; without labels only the base holds.
    """
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, v = quality_rules.judge(docs, C.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"{v}.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``, learned from the ids that are not held out.

    One row per document row, empty and null texts too.  A null id is not held out and not learned from;
    of a repeated id one text is learned from (``common.sample_by_class``).
    """
    docs = C.text_rows(C.table(spark, sf_dir, "documents"))
    labels = C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 5) != 0)
    weights = quality_classifier.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    scored, s = quality_classifier.score(docs, weights)
    return scored.select("doc_id", C.held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col(f"{s}.score"),
                         F.when(F.col(f"{s}.score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines of recurring templates, by ``line_dedup.dedup``: line counts and digest of the text.

    Rows that share an id are one document; null ids lose nothing; a null text has a null digest.
    """
    done = line_dedup.dedup(C.text_rows(C.table(spark, sf_dir, "documents")), report=True, min_tokens=1)
    return done.select("doc_id", "line_report.n_lines", "line_report.n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``, learned from the ids that are not held out.

    One row per document row, empty and null texts too.  A null id is not held out and not learned from.
    The verdict by the language's own threshold follows; a null language shares the one of all.
    """
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    labels = C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 3) != 1)
    found = toxicity.judge(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return found.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
                        F.col("threshold").alias("lang_threshold"), F.col("toxic").alias("lang_verdict"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the ids that are not held out.

    One row per document row; ``und`` with score 0 where there is no letter.  A null id is not held out
    and not learned from; null languages are not learned.
    """
    table = C.table(spark, sf_dir, "documents")
    docs = C.text_rows(table)
    learn = (table.where(C.fold(F.col("doc_id"), 3) != 1)
             .select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").alias("label")))
    languages, weights = language_id.train(learn)
    found, f = language_id.predict(docs, languages, weights)
    return found.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"),
                        F.col(f"{f}.lang").alias("lang_pred"), F.col(f"{f}.score"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of near copies of every whole text of ``documents``, by ``simhash.near_duplicates``.

    One row per document row; null and empty texts have fingerprint zero and are linked like any other.
    """
    found = simhash.near_duplicates(C.table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC records by ``warc.archive`` and read back: one row per page row.

    A null payload is empty; of equal payloads the record with the largest id is the response.
    """
    manifest, folder = warc.archive(C.table(spark, sf_dir, "pages"))
    found = warc.read(manifest, folder, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose id is divisible by 50, by ``hard_negatives.mine``.

    One row per anchor, positive and rank.  Rows without label, without vector or with a component that
    is null or not finite take no part; null ids are no anchors.
    """
    table = C.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = (table.where(hard_negatives.usable(F.col("embedding"), F.col("label")))
            .select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vector")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


#: tokenizer file of op12; every executor has it
TOKENIZER = "word_bpe_49k.json"


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of ``documents`` and the text decoded from them, as digests, by ``bpe``.

    One row per document row; a null text is empty.
    """
    import public_tokenizers
    path = public_tokenizers.path(TOKENIZER)
    found, t = bpe.encode(C.text_rows(C.table(spark, sf_dir, "documents")), path)
    back, d = bpe.decode(found.select("doc_id", f"{t}.n_tokens", f"{t}.ids"), path, "ids")
    return back.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.col(f"{d}.text").cast("binary"), 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best ``documents`` of every ``benchmark`` item, by ``ranked_search.rank``.

    Texts that are null or have no term are found by none and find none; ties go to the smaller id.
    """
    return ranked_search.rank(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_benchmark_decontamination, op4_quality_rules, op5_quality_classifier,
                                   op6_line_dedup, op7_toxicity, op8_language_id, op9_simhash_near_dedup, op10_warc,
                                   op11_hard_negatives, op12_bpe, op13_ranked_search)}
#: DuckDB SQL of the queries that SQL can express; the others are tested by brute force in tests/llm
ORACLE_SQL = {
    "op3_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM d, (SELECT DISTINCT m FROM bw) ms, unnest(range(1, len(w) - m + 2)) t(i)),
occ AS (SELECT rid, i, m, item_id FROM dw JOIN bw USING (m, win)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit
         FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM occ)) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
          FROM (SELECT DISTINCT rid, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN found USING (rid)
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM q
""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN (SELECT * FROM s WHERE NOT same) USING (anchor_id)
      WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
    "op13_ranked_search": r"""
WITH lowered AS (SELECT row_number() OVER () AS rid, doc_id,
                        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT rid, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM lowered WHERE len(t) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
i AS (SELECT row_number() OVER () AS iid, item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
it AS (SELECT iid, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT iid, unnest(t) AS term FROM i) GROUP BY ALL),
p AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT iid, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM it JOIN p USING (term) JOIN w USING (term) JOIN d USING (rid), g GROUP BY ALL),
r AS (SELECT iid, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (iid) WHERE rank <= 20
""",
}
