"""DuckDB SQL for each registered query (see ``oracle.py`` for the shared corpus CTEs)."""

from __future__ import annotations

from tagloom.constants import ALL_LABELS, added_vocab
from tagloom.plans.oracle import ORACLE, register, with_corpus

LABEL_VALUES = ", ".join(f"('{n}', {i})" for i, n in enumerate(ALL_LABELS))

# exploded characters and labels of the training corpus
CHAR_CTES = """
rc AS (SELECT r.id, c.ch, c.pos FROM reviews r, unnest(string_split(r.text, '')) WITH ORDINALITY AS c(ch, pos)
       WHERE r.text <> ''),
rl AS (SELECT r.id, l.label, l.pos FROM reviews r,
       unnest(regexp_split_to_array(trim(r.BIO_anno), '\\s+')) WITH ORDINALITY AS l(label, pos)
       WHERE trim(r.BIO_anno) <> '')
"""

register("scan_reviews", with_corpus("SELECT id, text, BIO_anno, class FROM reviews"))
register("scan_annotated", with_corpus("""
SELECT id, CASE WHEN problem IS NULL THEN text END AS text, CASE WHEN problem IS NULL THEN BIO_anno END AS BIO_anno,
       CASE WHEN problem IS NULL THEN class END AS class, problem
FROM (SELECT *, CASE WHEN id % 17 = 0 THEN 'malformed' WHEN id % 13 = 0 THEN 'no class' WHEN id % 11 = 0 THEN
             CASE WHEN length(text) = 1 THEN 'no labels' ELSE 'label count' END END AS problem FROM reviews)
"""))
register("scan_test", with_corpus("SELECT id, text FROM test_reviews"))

register("bio_split", with_corpus("""
SELECT id, CAST(count(*) AS INTEGER) AS n_labels, string_agg(label, ',' ORDER BY pos) AS labels
FROM rl GROUP BY id
""", CHAR_CTES))

register("label_encode", with_corpus(f"""
SELECT rl.id, string_agg(CAST(d.lid AS VARCHAR), ',' ORDER BY rl.pos) AS label_ids
FROM rl JOIN (VALUES {LABEL_VALUES}) d(name, lid) ON d.name = rl.label GROUP BY rl.id
""", CHAR_CTES))

register("label_decode", with_corpus("""
SELECT id, string_agg(CASE WHEN label LIKE 'B%' THEN 'I' || substr(label, 2) ELSE label END, ' ' ORDER BY pos)
       AS inner_labels
FROM rl GROUP BY id
""", CHAR_CTES))

register("char_labels", with_corpus("""
SELECT rc.id, CAST(count(*) AS INTEGER) AS n_pairs, string_agg(rc.ch || '/' || rl.label, '|' ORDER BY rc.pos) AS pairs
FROM rc JOIN rl ON rc.id = rl.id AND rc.pos = rl.pos GROUP BY rc.id
""", CHAR_CTES))

register("bio_spans", with_corpus("""
SELECT id, CAST(min(pos) - 1 AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS "end",
       substr(min_by(label, pos), 3) AS kind, string_agg(ch, '' ORDER BY pos) AS surface
FROM (
  SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY pos) AS isl
  FROM (
    SELECT rl.id, rl.pos, rl.label, rc.ch,
           CASE WHEN rl.label LIKE 'I-%'
                 AND lag(rl.label) OVER w SIMILAR TO '[BI]-.*'
                 AND substr(lag(rl.label) OVER w, 3) = substr(rl.label, 3) THEN 0 ELSE 1 END AS brk
    FROM rl JOIN rc ON rc.id = rl.id AND rc.pos = rl.pos
    WINDOW w AS (PARTITION BY rl.id ORDER BY rl.pos)) x) y
GROUP BY id, isl
HAVING min_by(label, pos) LIKE 'B-%'
""", CHAR_CTES))


# ---------------------------------------------------------------------------------
# tokenizer in SQL: vocabulary, pieces, tokens with positions
# ---------------------------------------------------------------------------------
FIXED_VOCAB_VALUES = ", ".join(f"('{w}')" for w in added_vocab())

VOCAB_CTES = f"""
vruns AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?: [A-Za-z]+)*')) AS run FROM reviews
          WHERE substr(md5('118:' || CAST(id AS VARCHAR)), 1, 8) < 'e6666666'),
mined AS (SELECT DISTINCT unnest(string_split(run, ' ')) AS word FROM vruns),
vocab AS (SELECT word FROM mined
          UNION SELECT unnest(string_split(w, ' ')) FROM (VALUES {FIXED_VOCAB_VALUES}) f(w))
"""


def token_ctes(src: str, p: str = "") -> str:
    """{p}tok(id, tpos, tok) for the rows of CTE ``src(id, text)``."""
    return f"""
{p}tp AS (SELECT s.id, u.piece, u.k FROM {src} s,
       unnest(regexp_extract_all(s.text, '[A-Za-z]+|[0-9]+|[^ ]')) WITH ORDINALITY AS u(piece, k)),
{p}tt AS (SELECT tp.id, tp.k,
              CASE WHEN regexp_matches(tp.piece, '^[A-Za-z]{{2,}}$') AND v.word IS NULL
                   THEN [substr(tp.piece, 1, 1), '##' || substr(tp.piece, 2)]
                   WHEN regexp_matches(tp.piece, '^[\\t\\n\\x0B\\f\\r]$') THEN ['[UNK]']
                   ELSE [tp.piece] END AS t
       FROM {p}tp tp LEFT JOIN vocab v ON v.word = tp.piece),
{p}tf AS (SELECT tt.id, tt.k, x.tok, x.j FROM {p}tt tt, unnest(tt.t) WITH ORDINALITY AS x(tok, j)),
{p}tok AS (SELECT id, tok, row_number() OVER (PARTITION BY id ORDER BY k, j) AS tpos FROM {p}tf)
"""


# non-blank character labels of the corpus, renumbered; token labels
ALIGN_CTES = """
nbl AS (SELECT rl.id, rl.label, row_number() OVER (PARTITION BY rl.id ORDER BY rl.pos) AS nbpos
        FROM rl JOIN rc ON rc.id = rl.id AND rc.pos = rl.pos WHERE rc.ch <> ' '),
toff AS (SELECT id, tpos, tok,
                coalesce(sum(CASE WHEN tok = '[UNK]' THEN 1 ELSE length(regexp_replace(tok, '^##', '')) END)
                         OVER (PARTITION BY id ORDER BY tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS off
         FROM tok),
tlab AS (SELECT toff.id, toff.tpos, toff.tok, nbl.label FROM toff LEFT JOIN nbl
         ON nbl.id = toff.id AND nbl.nbpos = toff.off + 1)
"""

# T05 expansion of src(id, tpos, tok, label): one row per character of the token text
def expand_ctes(src: str = "tlab", p: str = "") -> str:
    return f"""
{p}thead AS (SELECT *, sum(CASE WHEN tok LIKE '##%' THEN 0 ELSE 1 END)
                      OVER (PARTITION BY id ORDER BY tpos) AS grp FROM {src}),
{p}thead2 AS (SELECT *, CASE WHEN grp = 0 THEN NULL
                          ELSE first_value(label) OVER (PARTITION BY id, grp ORDER BY tpos) END AS head_label
           FROM {p}thead),
{p}tchar AS (SELECT id, tpos, i,
                 CASE WHEN tok = '[UNK]' THEN NULL
                      ELSE lower(substr(regexp_replace(tok, '^##', ''), i, 1)) END AS tch,
                 CASE WHEN tok LIKE '##%' THEN regexp_replace(head_label, '^B', 'I')
                      WHEN i = 1 THEN label ELSE regexp_replace(label, '^B', 'I') END AS clabel
          FROM {p}thead2, unnest(range(1, (CASE WHEN tok = '[UNK]' THEN 1
                                         ELSE length(regexp_replace(tok, '^##', '')) END) + 1)) AS g(i))
"""


def realign_sql(rc: str = "rc", tchar: str = "tchar", null_as: str = "∅") -> str:
    """T06 on characters rc(id, ch, pos): (id, realigned)."""
    return f"""
SELECT id, string_agg(lab, ' ' ORDER BY pos) AS realigned
FROM (
  SELECT c.id, c.pos,
         CASE WHEN c.ch = ' ' THEN 'O'
              WHEN t.tch IS NULL OR lower(c.ch) <> t.tch THEN 'O'
              ELSE coalesce(t.clabel, '{null_as}') END AS lab
  FROM (SELECT *, CASE WHEN ch <> ' ' THEN
                       sum(CASE WHEN ch <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) END AS nbk
        FROM {rc}) c
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tpos, i) AS kk FROM {tchar}) t
    ON t.id = c.id AND t.kk = c.nbk
  JOIN (SELECT e.id, least(e.n, coalesce(p.pos, 0) + (e.m - e.i0)) AS endpos
        FROM (SELECT k.id, k.m, k.i0, n.n
              FROM (SELECT id, count(*) AS m,
                           coalesce(max(CASE WHEN tch IS NOT NULL THEN kk END), 0) AS i0
                    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tpos, i) AS kk FROM {tchar}) z
                    GROUP BY id) k
              JOIN (SELECT id, count(*) AS n FROM {rc} GROUP BY id) n USING (id)) e
        LEFT JOIN (SELECT id, pos, sum(CASE WHEN ch <> ' ' THEN 1 ELSE 0 END)
                                     OVER (PARTITION BY id ORDER BY pos) AS nbk2, ch FROM {rc}) p
          ON p.id = e.id AND p.nbk2 = e.i0 AND p.ch <> ' ' AND e.i0 > 0) b
    ON b.id = c.id AND c.pos <= b.endpos) x
GROUP BY id
"""


register("vocab_mining", with_corpus("""
SELECT DISTINCT unnest(string_split(run, ' ')) AS word
FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?: [A-Za-z]+)*')) AS run FROM reviews)
"""))
register("vocab_trace", with_corpus("""
SELECT p.id, CAST(p.r - 1 AS BIGINT) AS k, p.w AS run, string_agg(rl.label, ' ' ORDER BY rl.pos) AS labels
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r
      FROM (SELECT id, k, w, coalesce(sum(length(w)) OVER (PARTITION BY id ORDER BY k
                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
            FROM reviews, unnest(regexp_extract_all(text, '[A-Za-z]+(?: [A-Za-z]+)*|[^A-Za-z]+')) WITH ORDINALITY AS u(w, k))
      WHERE regexp_matches(w, '^[A-Za-z]')) p
JOIN rl ON rl.id = p.id AND rl.pos > p.off AND rl.pos <= p.off + length(p.w)
GROUP BY p.id, p.r, p.w
""", CHAR_CTES))
register("vocab_list", with_corpus("SELECT word FROM vocab", VOCAB_CTES))

register("tokenize_corpus", with_corpus("""
SELECT id, CAST((tpos - 1) // 198 AS BIGINT) AS win, CAST(count(*) AS INTEGER) AS n_tokens,
       string_agg(tok, ' ' ORDER BY tpos) AS tokens,
       '101,' || string_agg(CAST(CASE WHEN tok = '[UNK]' THEN 100 WHEN length(tok) = 1 THEN 1000 + unicode(tok)
                                 ELSE 2000000 + rank END AS VARCHAR), ',' ORDER BY tpos) || ',102'
         || repeat(',0', 198 - CAST(count(*) AS INTEGER)) AS input_ids,
       CAST(count(*) + 2 AS INTEGER) AS n_attended
FROM tok LEFT JOIN ranks USING (tok) GROUP BY id, (tpos - 1) // 198
""", VOCAB_CTES + "," + token_ctes("docs") + """,
ranks AS (SELECT tok, row_number() OVER (ORDER BY md5(tok), tok) - 1 AS rank
          FROM (SELECT DISTINCT tok FROM tok WHERE length(tok) > 1 AND tok <> '[UNK]'))
"""))

register("strip_blank_labels", with_corpus("""
SELECT rc.id, string_agg(rl.label, ' ' ORDER BY rc.pos) AS labels_nb
FROM rc JOIN rl ON rc.id = rl.id AND rc.pos = rl.pos WHERE rc.ch <> ' ' GROUP BY rc.id
""", CHAR_CTES))

register("mark_text", with_corpus("""
SELECT rc.id, string_agg(CASE WHEN rl.label = 'O' THEN '' ELSE rl.label END || rc.ch, '' ORDER BY rc.pos) AS marked
FROM rc JOIN rl ON rc.id = rl.id AND rc.pos = rl.pos GROUP BY rc.id
""", CHAR_CTES))

register("bio_inner", with_corpus("""
SELECT id, string_agg(regexp_replace(label, '^B', 'I'), ' ' ORDER BY pos) AS inner_labels FROM rl GROUP BY id
""", CHAR_CTES))

_TOK_REVIEWS = CHAR_CTES + "," + VOCAB_CTES + "," + token_ctes("reviews") + "," + ALIGN_CTES

register("align_labels", with_corpus("""
SELECT id, CAST(count(*) AS INTEGER) AS n_tokens,
       string_agg(coalesce(label, '∅'), ' ' ORDER BY tpos) AS token_labels
FROM tlab GROUP BY id
""", _TOK_REVIEWS))

register("expand_labels", with_corpus("""
SELECT id, string_agg(coalesce(clabel, '∅'), ' ' ORDER BY tpos, i) AS char_labels FROM tchar GROUP BY id
""", _TOK_REVIEWS + "," + expand_ctes()))

register("realign_labels", with_corpus(realign_sql(), _TOK_REVIEWS + "," + expand_ctes()))

_LABEL_ID_CASE = "CASE label " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(ALL_LABELS)) + " END"

register("frame_pad", with_corpus(f"""
SELECT id, CAST((tpos - 1) // 198 AS BIGINT) AS win, '9,' || string_agg(CAST({_LABEL_ID_CASE} AS VARCHAR), ',' ORDER BY tpos) || ',10'
             || repeat(',11', 198 - CAST(count(*) AS INTEGER)) AS label_ids
FROM tlab GROUP BY id, (tpos - 1) // 198
""", _TOK_REVIEWS))

register("mask_positions", with_corpus(f"""
SELECT id, CAST((tpos - 1) // 198 AS BIGINT) AS win, CAST(count(*) + 2 AS INTEGER) AS n_valid,
       '9,' || string_agg(CAST({_LABEL_ID_CASE} AS VARCHAR), ',' ORDER BY tpos) || ',10' AS valid_ids
FROM tlab GROUP BY id, (tpos - 1) // 198
""", _TOK_REVIEWS))

register("strip_frame", with_corpus(f"""
SELECT id, CAST((tpos - 1) // 198 AS BIGINT) AS win,
       string_agg(CAST({_LABEL_ID_CASE} AS VARCHAR), ',' ORDER BY tpos) AS label_ids
FROM tlab GROUP BY id, (tpos - 1) // 198
""", _TOK_REVIEWS))

register("normalise_text", with_corpus("""
SELECT id, lower(replace(regexp_replace(replace(string_agg(tok, ' ' ORDER BY tpos), ' ##', ''), '\\s+', '', 'g'),
                         '[UNK]', 'ø')) AS normalised
FROM tok GROUP BY id
""", VOCAB_CTES + "," + token_ctes("docs")))


# ---------------------------------------------------------------------------------
# corpus assembly, sampling, metrics
# ---------------------------------------------------------------------------------
def h(seed, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


AUX_CTES = """
gpt AS (SELECT text, CAST(conv_id % 3 AS INTEGER) AS class FROM conversations WHERE role = 'assistant'),
ext AS (SELECT text, CAST(doc_id % 3 AS INTEGER) AS class FROM documents WHERE source = 'src0'),
trans AS (SELECT item_id AS oid, text, CAST(item_id % 3 AS INTEGER) AS class FROM benchmark),
corpus AS (
  SELECT id, NULL::BIGINT AS oid, text, class, 'origin' AS type FROM reviews
  UNION ALL SELECT NULL, NULL, text, class, 'gpt' FROM gpt
  UNION ALL SELECT NULL, NULL, text, class, 'ext' FROM ext
  UNION ALL SELECT NULL, oid, text, class, 'trans' FROM trans),
split AS (SELECT id, text, class, CASE WHEN substr(""" + h(118, "id") + """, 1, 8) < 'e6666666'
                                  THEN 'train' ELSE 'val' END AS split FROM reviews),
train_aug AS (SELECT id, class, 'origin' AS type FROM split WHERE split = 'train'
              UNION ALL SELECT NULL, class, 'gpt' FROM gpt)
"""

register("scan_aux", """
SELECT 'gpt' AS type, text, CAST(conv_id % 3 AS INTEGER) AS class FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'ext', text, CAST(doc_id % 3 AS INTEGER) FROM documents
UNION ALL SELECT 'trans', text, CAST(item_id % 3 AS INTEGER) FROM benchmark
""")
register("filter_category", """
SELECT source AS cat, CAST(doc_id % 3 AS INTEGER) AS label, text AS review FROM documents WHERE source = 'src0'
""")
register("harmonise_columns", "SELECT text, CAST(doc_id % 3 AS INTEGER) AS class FROM documents WHERE source = 'src0'")
register("corpus_union", with_corpus("SELECT id, oid, text, class, type FROM corpus", AUX_CTES))
register("corpus_no_origin", with_corpus("""
SELECT CAST(NULL AS BIGINT) AS id, text, class, type FROM corpus WHERE type IN ('gpt', 'ext')
""", AUX_CTES))
register("corpus_marked", with_corpus("""
SELECT r.id, m.text, r.class, 'origin' AS type FROM reviews r JOIN (
  SELECT rc.id, string_agg(CASE WHEN rl.label = 'O' THEN '' ELSE rl.label END || rc.ch, '' ORDER BY rc.pos) AS text
  FROM rc JOIN rl ON rc.id = rl.id AND rc.pos = rl.pos GROUP BY rc.id) m USING (id)
UNION ALL SELECT NULL, text, class, 'gpt' FROM gpt
""", AUX_CTES + "," + CHAR_CTES))
register("class_strict", with_corpus("SELECT type, class, count(*) AS n FROM corpus GROUP BY type, class", AUX_CTES))
register("null_rows", with_corpus("""
SELECT id, oid, class, type FROM corpus WHERE id IS NULL OR oid IS NULL OR class IS NULL OR type IS NULL
""", AUX_CTES))
register("split_90_10", with_corpus("SELECT id, split FROM split", AUX_CTES))
register("split_then_augment", with_corpus("SELECT id, class, type FROM train_aug", AUX_CTES))
register("dataset_sizes", with_corpus("""
SELECT 'train' AS split, count(*) AS n FROM train_aug
UNION ALL SELECT 'val', count(*) FROM split WHERE split = 'val'
""", AUX_CTES))
register("debug_head", with_corpus("SELECT id, class FROM reviews ORDER BY id LIMIT 40"))
register("sample_n", with_corpus(f"SELECT id, class FROM reviews ORDER BY {h(118, 'id')}, id LIMIT 50"))
register("sample_replace", with_corpus(f"""
SELECT d.draw, r.id FROM (
  SELECT unnest(range(idx * 2, idx * 2 + 2)) AS draw FROM ranked) d0,
  LATERAL (SELECT d0.draw AS draw,
                  CAST(('0x' || substr(md5('118:draw:' || CAST(d0.draw AS VARCHAR)), 1, 15)) AS BIGINT)
                    % (SELECT count(*) FROM reviews) AS pick) d
JOIN ranked r ON r.idx = d.pick
""", f"ranked AS (SELECT id, row_number() OVER (ORDER BY {h(118, 'id')}, id) - 1 AS idx FROM reviews)"))
register("batching", with_corpus(f"""
SELECT id, split, CAST((row_number() OVER (PARTITION BY split ORDER BY {h(119, 'id')}, id) - 1) // 40 AS BIGINT)
       AS batch_id FROM split
""", AUX_CTES))
register("batching_in_place", with_corpus("""
SELECT split, b AS batch_id, least(40, n - 40 * b) AS n
FROM (SELECT split, count(*) AS n FROM split GROUP BY split) s, unnest(range((n + 39) // 40)) AS u(b)
""", AUX_CTES))
register("flatten_preds", with_corpus(f"""
SELECT split, batch_id, CAST(count(*) AS INTEGER) AS n_positions,
       string_agg(CAST({_LABEL_ID_CASE} AS VARCHAR), ',' ORDER BY idx, tpos) AS flat
FROM tlab JOIN (SELECT id, split, idx, CAST(idx // 40 AS BIGINT) AS batch_id
                FROM (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY {h(119, 'id')}, id) - 1 AS idx
                      FROM (SELECT id, CASE WHEN substr({h(118, 'id')}, 1, 8) < 'e6666666' THEN 'train' ELSE 'val' END AS split
                            FROM reviews))) USING (id)
GROUP BY split, batch_id
""", _TOK_REVIEWS))

EPOCH_CTES = """
items AS (SELECT (user_id // 10) % 20 AS run, event_id // 500 AS epoch0, event_id % 20 AS batch,
                 CASE WHEN user_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, value AS loss,
                 CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit,
                 (event_type = 'error' AND value > 450) AS failed FROM events),
bm AS (SELECT run, epoch0, split, batch,
              CASE WHEN bool_or(failed) THEN NULL ELSE avg(loss) END AS loss, avg(hit) AS acc
       FROM items GROUP BY ALL),
ep AS (SELECT t.run, t.epoch0 + 1 AS epoch, t.loss, t.acc, v.val_acc FROM
         (SELECT run, epoch0, sum(coalesce(loss, 0)) / count(*) AS loss, avg(acc) AS acc
          FROM bm WHERE split = 'train' GROUP BY ALL) t
       LEFT JOIN (SELECT run, epoch0, avg(acc) AS val_acc FROM bm WHERE split = 'val' GROUP BY ALL) v
       USING (run, epoch0))
"""
register("epoch_rollup", f"""WITH {EPOCH_CTES.strip()}
SELECT run, epoch, round(loss, 8) AS loss, round(acc, 8) AS acc, round(val_acc, 8) AS val_acc FROM ep""")
register("epoch_log", f"""WITH {EPOCH_CTES.strip()}
SELECT run, CAST(epoch AS INTEGER) AS epoch, round(round(loss, 8), 8) AS loss, round(round(acc, 8), 8) AS acc,
       round(round(val_acc, 8), 8) AS val_acc FROM ep""")
register("epoch_log_batches", f"""WITH {EPOCH_CTES.strip()},
vb AS (SELECT run, epoch0 + 1 AS epoch, count(*) AS n, avg(acc) AS mean, min_by(acc, batch) AS first_acc
       FROM bm WHERE split = 'val' GROUP BY ALL)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY epoch) AS number, CAST(epoch AS INTEGER) AS epoch, round(val_acc, 8) AS val_acc,
       CAST(coalesce(n, 0) AS INTEGER) AS n_batches, round(mean, 8) AS batch_mean, round(first_acc, 8) AS first_acc
FROM ep LEFT JOIN vb USING (run, epoch)""")
register("best_epoch", f"""WITH {EPOCH_CTES.strip()}
SELECT run, epoch, round(val_acc, 8) AS val_acc, is_best, is_best OR (epoch - 1) % 5 = 0 AS saved
FROM (SELECT *, coalesce(val_acc > coalesce(max(val_acc) OVER (PARTITION BY run ORDER BY epoch
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS is_best
      FROM ep)""")
register("argmax_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings
""")


# ---------------------------------------------------------------------------------
# augmentation and back-translation ingest
# ---------------------------------------------------------------------------------
from tagloom.constants import bank_lexicon_rows  # noqa: E402
from tagloom.operators.augment import alias_pool  # noqa: E402
from tagloom.streaming.ingest import SYSTEM_PROMPT  # noqa: E402

BANK_WIDE_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in bank_lexicon_rows())
ALIAS_POOL_VALUES = ", ".join(f"({i}, '{a}')" for i, a in enumerate(alias_pool()))

register("lexicon_long", with_corpus(f"""
SELECT kind, alias FROM (UNPIVOT (SELECT * FROM (VALUES {BANK_WIDE_VALUES}) w(bank, cn, en))
                         ON bank, cn, en INTO NAME kind VALUE alias)
UNION ALL
SELECT DISTINCT 'corpus', surface FROM (
  SELECT id, isl, string_agg(ch, '' ORDER BY pos) AS surface, min_by(label, pos) AS head
  FROM (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY pos) AS isl
        FROM (SELECT rl.id, rl.pos, rl.label, rc.ch,
                     CASE WHEN rl.label = 'I-BANK' AND lag(rl.label) OVER w IN ('B-BANK', 'I-BANK') THEN 0 ELSE 1 END AS brk
              FROM rl JOIN rc ON rc.id = rl.id AND rc.pos = rl.pos WINDOW w AS (PARTITION BY rl.id ORDER BY rl.pos)))
  GROUP BY id, isl)
WHERE head = 'B-BANK'
""", CHAR_CTES))

_MENTIONS = """
c0 AS (SELECT rl.id, rl.pos, rl.label, rc.ch,
              CASE WHEN rl.label = 'I-BANK' AND lag(rl.label) OVER w IN ('B-BANK', 'I-BANK') THEN 0 ELSE 1 END AS brk
       FROM rl JOIN rc ON rc.id = rl.id AND rc.pos = rl.pos WINDOW w AS (PARTITION BY rl.id ORDER BY rl.pos)),
ci AS (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY pos) AS isl FROM c0),
cm AS (SELECT *, first_value(label) OVER (PARTITION BY id, isl ORDER BY pos) AS head,
              pos = min(pos) OVER (PARTITION BY id, isl) AS is_first FROM ci),
mention AS (SELECT id, isl, row_number() OVER (PARTITION BY id ORDER BY isl) AS m FROM cm
            WHERE head = 'B-BANK' AND is_first),
"""


def replaced_ctes(pool: str, n: str) -> str:
    """The mentions of BANK and the alias picked for each from ``pool(k, alias)`` of ``n`` rows."""
    return _MENTIONS + f"""
pool(k, alias) AS ({pool}),
picked AS (SELECT mention.id, mention.isl, pool.alias FROM mention JOIN pool
           ON pool.k = CAST(('0x' || substr(md5('118:' || CAST(mention.id AS VARCHAR) || ':'
                                                || CAST(mention.m AS VARCHAR)), 1, 15)) AS BIGINT) % {n})
"""


_REPLACE = """
SELECT cm.id,
       string_agg(CASE WHEN cm.head = 'B-BANK' THEN (CASE WHEN cm.is_first THEN p.alias ELSE '' END) ELSE cm.ch END,
                  '' ORDER BY cm.pos) AS text,
       string_agg(CASE WHEN cm.head = 'B-BANK'
                       THEN (CASE WHEN cm.is_first THEN 'B-BANK' || repeat(' I-BANK', length(p.alias) - 1) END)
                       ELSE cm.label END, ' ' ORDER BY cm.pos) AS BIO_anno
FROM cm LEFT JOIN picked p ON p.id = cm.id AND p.isl = cm.isl
GROUP BY cm.id
"""
register("entity_replace", with_corpus(_REPLACE, CHAR_CTES + "," + replaced_ctes(f"VALUES {ALIAS_POOL_VALUES}", "150")))
register("lexicon_replace", with_corpus(_REPLACE, CHAR_CTES + "," + replaced_ctes(
    "SELECT row_number() OVER (ORDER BY c_custkey) - 1, c_name FROM customer", "(SELECT count(*) FROM customer)")))

register("callback_replace", with_corpus(_REPLACE, CHAR_CTES + "," + _MENTIONS + """
picked AS (SELECT cm.id, cm.isl, '[' || string_agg(cm.ch, '' ORDER BY cm.pos) || '#' || any_value(mention.m) || ']' AS alias
           FROM cm JOIN mention ON mention.id = cm.id AND mention.isl = cm.isl GROUP BY cm.id, cm.isl)
"""))

register("bracket_perturb", with_corpus("""
SELECT id, string_agg(CASE WHEN hit THEN '<' || w || '>' ELSE w END, '' ORDER BY k) AS text,
       string_agg(CASE WHEN hit THEN wl || ' ' || lastl || ' ' || lastl ELSE wl END, ' ' ORDER BY k) AS BIO_anno
FROM (
  SELECT p.id, p.k, p.w, p.hit, string_agg(rl.label, ' ' ORDER BY rl.pos) AS wl, arg_max(rl.label, rl.pos) AS lastl
  FROM (SELECT id, k, w,
               coalesce(sum(length(w)) OVER (PARTITION BY id ORDER BY k
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
               regexp_matches(w, '^[A-Za-z\\x{4e00}-\\x{9fff}]')
                 AND CAST(('0x' || substr(md5('125:p:' || CAST(id AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 15))
                          AS BIGINT) / 1152921504606846976.0 < 0.1 AS hit
        FROM reviews, unnest(regexp_extract_all(text, '[A-Za-z]+|[\\x{4e00}-\\x{9fff}]{1,2}|[^A-Za-z\\x{4e00}-\\x{9fff}]+')) WITH ORDINALITY AS u(w, k)) p
  JOIN rl ON rl.id = p.id AND rl.pos > p.off AND rl.pos <= p.off + length(p.w)
  GROUP BY p.id, p.k, p.w, p.hit) x
GROUP BY id
""", CHAR_CTES))

register("request_table", with_corpus(f"""
SELECT id AS oid, rep, '{SYSTEM_PROMPT}' AS system, text AS "user"
FROM (SELECT id, text FROM reviews ORDER BY md5('118:' || CAST(id AS VARCHAR)), id LIMIT 50) s,
     unnest([1, 2]) AS r(rep)
"""))

RESP_CTES = f"""
resp AS (SELECT doc_id AS oid,
                CASE WHEN doc_id % 20 = 10 THEN lang || '#####' || source || '#####' || text
                     WHEN doc_id % 10 = 0 THEN text ELSE lang || '#####' || text END AS content FROM documents),
rsplit AS (SELECT oid,
                  CASE WHEN len(string_split(content, '#####')) = 2 THEN string_split(content, '#####')[1]
                       ELSE CAST(to_json(string_split(content, '#####')) AS VARCHAR) END AS en,
                  CASE WHEN len(string_split(content, '#####')) = 2 THEN string_split(content, '#####')[2]
                       ELSE 'ERR' END AS cn FROM resp)
"""
register("response_split", f"WITH {RESP_CTES.strip()} SELECT oid, en, cn FROM rsplit")
register("stream_ingest_responses", f"WITH {RESP_CTES.strip()} SELECT oid, en, cn FROM rsplit")
register("open_requests", with_corpus("""
SELECT id AS oid, CAST(2 AS INTEGER) AS rep, text AS "user" FROM reviews WHERE id % 3 <> 0
"""))
register("backtranslation_join", with_corpus("""
SELECT r.oid, r.cn AS text, v.class FROM rsplit r JOIN reviews v ON v.id = r.oid WHERE r.cn <> 'ERR'
""", RESP_CTES))


# ---------------------------------------------------------------------------------
# count models: fits, decode (one recursion step per position), moods, submissions
# ---------------------------------------------------------------------------------
from tagloom.constants import ENTITY_LABELS  # noqa: E402

_ENT = ", ".join(f"'{n}'" for n in ENTITY_LABELS)
_ALL_NAMES = ", ".join(f"('{n}')" for n in ALL_LABELS)
_TRAIN = f"substr({h(118, 'id')}, 1, 8) < 'e6666666'"
_OK = ("(to_label IN ('O', '[EOS]') OR to_label LIKE 'B-%' OR to_label = regexp_replace(from_label, '^B', 'I'))")


def micro(x: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


def bigram_sql(src: str) -> str:
    """Framed label bigrams of src(id, tpos, label): (id, pos, from_label, to_label)."""
    return f"""SELECT id, CAST(tpos - 1 AS BIGINT) AS pos,
  coalesce(lag(label) OVER (PARTITION BY id ORDER BY tpos), '[SOS]') AS from_label, label AS to_label FROM {src}
UNION ALL SELECT id, CAST(max(tpos) AS BIGINT), arg_max(label, tpos), '[EOS]' FROM {src} GROUP BY id"""


MODEL_CTES = f"""
tw AS (SELECT id, tpos, tok, label, {_TRAIN} AS is_train FROM tlab),
trw AS (SELECT * FROM tw WHERE is_train),
pairs AS ({bigram_sql('trw')}),
trans AS (
  SELECT from_label, to_label, {_OK} AS allowed, coalesce(c.n, 0) AS n,
         CASE WHEN {_OK} THEN ln((coalesce(c.n, 0) + 1) / (coalesce(t.n_from, 0) + 12.0)) ELSE -100.0 END AS score
  FROM (SELECT a.n AS from_label, b.n AS to_label FROM (VALUES {_ALL_NAMES}) a(n), (VALUES {_ALL_NAMES}) b(n)) g
  LEFT JOIN (SELECT from_label, to_label, count(*) AS n FROM pairs GROUP BY ALL) c USING (from_label, to_label)
  LEFT JOIN (SELECT from_label, count(*) AS n_from FROM pairs GROUP BY ALL) t USING (from_label)),
emcnt AS (SELECT label, tok AS token, count(*) AS n FROM trw WHERE label IN ({_ENT}) GROUP BY ALL),
emlab AS (SELECT label, sum(n) AS n_label FROM emcnt GROUP BY ALL),
emv AS (SELECT count(DISTINCT token) AS v FROM emcnt)
"""

# score vectors by token, the vector of an unseen token, and the transitions as lists
SCORE_CTES = f"""
labs(label, j) AS (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(ENTITY_LABELS))}),
unseen AS (SELECT label, j, {micro('ln(1.0 / (coalesce(n_label, 0) + v))')} AS u FROM labs LEFT JOIN emlab USING (label), emv),
unseenv AS (SELECT list(u ORDER BY j) AS v FROM unseen),
emtok AS (SELECT t.token, list(coalesce({micro('ln((c.n + 1) / (l.n_label + emv.v))')}, u.u) ORDER BY u.j) AS v
          FROM (SELECT DISTINCT token FROM emcnt) t CROSS JOIN unseen u CROSS JOIN emv
          LEFT JOIN emcnt c ON c.token = t.token AND c.label = u.label LEFT JOIN emlab l ON l.label = u.label
          GROUP BY t.token),
tr AS (SELECT (SELECT list({micro('score')} ORDER BY a.j, b.j) FROM trans JOIN labs a ON a.label = from_label JOIN labs b ON b.label = to_label) AS tr,
              (SELECT list({micro('score')} ORDER BY b.j) FROM trans JOIN labs b ON b.label = to_label WHERE from_label = '[SOS]') AS st,
              (SELECT list({micro('score')} ORDER BY a.j) FROM trans JOIN labs a ON a.label = from_label WHERE to_label = '[EOS]') AS en)
"""


def em_cte(tok: str, p: str = "") -> str:
    """{p}em(id, pos, v): the score vector of every token of tok(id, tpos, tok)."""
    return f"""
{p}em AS (SELECT t.id, t.tpos AS pos, coalesce(e.v, unseenv.v) AS v
       FROM {tok} t LEFT JOIN emtok e ON e.token = t.tok, unseenv)
"""


_CAND = "list_transform(range(0, 9), lambda i: v.s[i + 1] + tr.tr[i * 9 + j + 1])"


def viterbi_ctes(tok: str, p: str = "") -> str:
    """{p}path(id, tpos, tok, label): the decoded label of every token of tok(id, tpos, tok)."""
    return em_cte(tok, p) + f""",
{p}vit AS (
  SELECT e.id, e.pos, list_transform(range(0, 9), lambda j: e.v[j + 1] + tr.st[j + 1]) AS s, CAST(NULL AS BIGINT[]) AS bp
  FROM {p}em e, tr WHERE e.pos = 1
  UNION ALL
  SELECT e.id, e.pos, list_transform(range(0, 9), lambda j: list_max({_CAND}) + e.v[j + 1]),
         list_transform(range(0, 9), lambda j: list_position({_CAND}, list_max({_CAND})) - 1)
  FROM {p}vit v JOIN {p}em e ON e.id = v.id AND e.pos = v.pos + 1, tr),
{p}fin AS (SELECT v.id, v.pos, v.bp, list_transform(range(0, 9), lambda j: v.s[j + 1] + tr.en[j + 1]) AS f
        FROM {p}vit v JOIN (SELECT id, max(tpos) AS n FROM {tok} GROUP BY id) l ON l.id = v.id AND l.n = v.pos, tr),
{p}bt AS (
  SELECT id, pos, CAST(list_position(f, list_max(f)) - 1 AS BIGINT) AS j FROM {p}fin
  UNION ALL
  SELECT b.id, b.pos - 1, CAST(w.bp[b.j + 1] AS BIGINT) FROM {p}bt b JOIN {p}vit w ON w.id = b.id AND w.pos = b.pos WHERE b.pos > 1),
{p}path AS (SELECT t.id, t.tpos, t.tok, labs.label FROM {tok} t JOIN {p}bt b ON b.id = t.id AND b.pos = t.tpos JOIN labs ON labs.j = b.j)
"""


_FIT = _TOK_REVIEWS + "," + MODEL_CTES
_VAL = _FIT + "," + SCORE_CTES + """,
val AS (SELECT id, tpos, tok, label AS gold FROM tw WHERE NOT is_train)
"""

register("bio_transitions", with_corpus(
    "SELECT from_label, to_label, allowed, n, round(score, 6) AS score FROM trans", _FIT))

register("tagger_fit", with_corpus("""
SELECT c.label, c.token, c.n, round(ln((c.n + 1) / (l.n_label + emv.v)), 6) AS logp
FROM emcnt c JOIN emlab l USING (label), emv
""", _FIT))

_ARGMAX = _VAL + "," + em_cte("val") + """,
arg AS (SELECT e.id, e.pos AS tpos, labs.label FROM em e JOIN labs ON labs.j = list_position(e.v, list_max(e.v)) - 1)
"""
register("tagger_argmax", with_corpus(
    "SELECT id, string_agg(label, ' ' ORDER BY tpos) AS pred FROM arg GROUP BY id", _ARGMAX))
register("bio_audit", with_corpus(
    f"SELECT id, pos, from_label, to_label FROM ({bigram_sql('arg')}) WHERE NOT {_OK}", _ARGMAX))

_DECODED = _VAL + "," + viterbi_ctes("val")
register("tagger_decode", with_corpus(
    "SELECT id, string_agg(label, ' ' ORDER BY tpos) AS pred FROM path GROUP BY id", _DECODED))

register("path_nll", with_corpus(f"""
SELECT id, -CAST(sum(x) AS DOUBLE) / 1000000 AS nll FROM (
  SELECT e.id, e.v[labs.j + 1] AS x FROM em e JOIN val ON val.id = e.id AND val.tpos = e.pos JOIN labs ON labs.label = val.gold
  UNION ALL
  SELECT g.id, {micro('t.score')} FROM ({bigram_sql('(SELECT id, tpos, gold AS label FROM val)')}) g
  JOIN trans t USING (from_label, to_label))
GROUP BY id
""", _VAL + "," + em_cte("val")))

register("token_accuracy", with_corpus(f"""
SELECT CAST((rk - 1) // 40 AS BIGINT) AS batch_id, round(sum(hits) / sum(n), 6) AS acc
FROM (SELECT id, hits, n, row_number() OVER (ORDER BY {h(119, 'id')}, id) AS rk
      FROM (SELECT val.id, sum(CASE WHEN val.gold = path.label THEN 1 ELSE 0 END) + 2 AS hits, count(*) + 2 AS n
            FROM val JOIN path ON path.id = val.id AND path.tpos = val.tpos GROUP BY val.id))
GROUP BY (rk - 1) // 40
""", _DECODED))


def mood_ctes(origin: str = "SELECT id, text, class FROM reviews") -> str:
    """The mood model of the train part of ``origin`` and the generated rows."""
    return f"""
mtrain AS (SELECT row_number() OVER () AS id, text, class FROM (
  SELECT text, class FROM ({origin}) WHERE {_TRAIN}
  UNION ALL SELECT text, CAST(conv_id % 3 AS INTEGER) FROM conversations WHERE role = 'assistant')),
{token_ctes('mtrain', 'm').strip()},
mcnt AS (SELECT class, tok AS token, count(*) AS n FROM mtok JOIN mtrain USING (id) GROUP BY ALL),
mv AS (SELECT count(DISTINCT token) AS v FROM mcnt),
mcls AS (SELECT class, sum(n) AS n_class FROM mcnt GROUP BY ALL),
mlog AS (SELECT class, token, n, ln((n + 1) / (n_class + v)) AS logp FROM mcnt JOIN mcls USING (class), mv),
mseen AS (SELECT DISTINCT token FROM mcnt),
mpr AS (SELECT class, {micro('ln(nd / (SELECT count(*) FROM mtrain))')} AS prior, {micro('ln(1.0 / (n_class + v))')} AS unseen
        FROM (SELECT class, count(*) AS nd FROM mtrain GROUP BY ALL) JOIN mcls USING (class), mv)
"""


def mood_sql(src: str, tok: str) -> str:
    """Predicted class of src(id): (id, class)."""
    return f"""
SELECT id, CAST(arg_min(class, [-score, class]) AS INTEGER) AS class FROM (
  SELECT d.id, p.class, p.prior + coalesce(sum(coalesce({micro('m.logp')}, p.unseen)) FILTER (WHERE s.token IS NOT NULL), 0) AS score
  FROM {src} d CROSS JOIN mpr p
  LEFT JOIN {tok} q ON q.id = d.id
  LEFT JOIN mseen s ON s.token = q.tok
  LEFT JOIN mlog m ON m.token = q.tok AND m.class = p.class
  GROUP BY d.id, p.class, p.prior)
GROUP BY id
"""


register("mood_fit", with_corpus("SELECT class, token, n, round(logp, 6) AS logp FROM mlog", VOCAB_CTES + "," + mood_ctes()))
register("mood_predict", with_corpus(mood_sql("test_reviews", "qtok"),
                                     VOCAB_CTES + "," + mood_ctes() + "," + token_ctes("test_reviews", "q")))
register("class_accuracy", with_corpus(f"""
SELECT CAST((rk - 1) // 40 AS BIGINT) AS batch_id, round(avg(hit), 6) AS acc
FROM (SELECT CASE WHEN p.class = v.class THEN 1.0 ELSE 0.0 END AS hit, row_number() OVER (ORDER BY {h(119, 'v.id')}, v.id) AS rk
      FROM vr v JOIN ({mood_sql('vr', 'qtok')}) p USING (id))
GROUP BY (rk - 1) // 40
""", VOCAB_CTES + "," + mood_ctes() + f""",
vr AS (SELECT id, text, class FROM reviews WHERE NOT ({_TRAIN})),
""" + token_ctes("vr", "q").strip()))

# the tagged test set: tokens, decode, expansion, realignment
_TAGGED = _FIT + "," + SCORE_CTES + "," + token_ctes("test_reviews", "q") + "," + viterbi_ctes("qtok", "q") + "," \
    + expand_ctes("qpath", "q") + f""",
qrc AS (SELECT t.id, c.ch, c.pos FROM test_reviews t, unnest(string_split(t.text, '')) WITH ORDINALITY AS c(ch, pos)
        WHERE t.text <> ''),
qbio AS (SELECT t.id, coalesce(r.realigned, '') AS BIO_anno FROM test_reviews t LEFT JOIN ({realign_sql('qrc', 'qtchar', 'O')}) r USING (id))
"""
register("tag_corpus", with_corpus("SELECT id, BIO_anno FROM qbio", _TAGGED))
_SUBMISSION = with_corpus(f"SELECT id, BIO_anno, class FROM qbio JOIN ({mood_sql('test_reviews', 'qtok')}) USING (id)",
                          _TAGGED + "," + mood_ctes())
register("submission", _SUBMISSION)
register("submission_csv", _SUBMISSION)
register("stream_submission", _SUBMISSION)


def marked_sql(chars: str, labels: str) -> str:
    return f"""SELECT c.id, string_agg(CASE WHEN l.label = 'O' THEN '' ELSE l.label END || c.ch, '' ORDER BY c.pos) AS text
FROM {chars} c JOIN {labels} l ON l.id = c.id AND l.pos = c.pos GROUP BY c.id"""


register("two_stage_submission", with_corpus(
    f"SELECT id, BIO_anno, class FROM qbio JOIN ({mood_sql('test_reviews', 'wtok')}) USING (id)",
    _TAGGED + f""",
qrl AS (SELECT q.id, l.label, l.pos FROM qbio q, unnest(string_split(q.BIO_anno, ' ')) WITH ORDINALITY AS l(label, pos)
        WHERE q.BIO_anno <> ''),
marked AS ({marked_sql('qrc', 'qrl')}),
omarked AS ({marked_sql('rc', 'rl')}),
""" + mood_ctes("SELECT r.id, o.text, r.class FROM reviews r JOIN omarked o USING (id)").strip() + "," + token_ctes("marked", "w")))

# Originals plus the resampled rows after entity replacement; mentions are picked by id, so
# every draw of a row is replaced alike
_REPLACED = ORACLE["entity_replace"]
register("augment_union", f"""
WITH rep AS ({_REPLACED}), orig AS ({ORACLE["scan_reviews"]}), drawn AS ({ORACLE["sample_replace"]})
SELECT id, CAST(NULL AS BIGINT) AS draw, class, text, regexp_replace(trim(BIO_anno), '\\s+', ' ', 'g') AS BIO_anno FROM orig
UNION ALL
SELECT d.id, d.draw, o.class, r.text, r.BIO_anno FROM drawn d JOIN rep r USING (id) JOIN orig o USING (id)
""")
