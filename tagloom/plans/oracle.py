"""Independent DuckDB formulations of the registered queries.

The oracle deliberately takes a different shape where that is cheap: sequences are
exploded with ``unnest ... WITH ORDINALITY`` and rebuilt with ordered ``string_agg``
where the Spark side uses row-local folds.
"""

from __future__ import annotations

import re

from tagloom.constants import CORPUS_LEXICON, CORPUS_PAIRS

ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def _kind_case(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CORPUS_LEXICON.items())
    return f"(CASE lower({x}) {whens} END)"


def _pair_case(a: str, blank: str, b: str) -> str:
    whens = " ".join(f"WHEN '{x} {y}' THEN '{v}'" for (x, y), v in CORPUS_PAIRS.items())
    return f"(CASE WHEN {blank} = ' ' THEN CASE lower({a}) || ' ' || lower({b}) {whens} END END)"


# The derived corpus as CTEs: docs(id,text,source), cls(id,class), tagged(id,text,source,BIO_anno),
# reviews(id,text,BIO_anno,class,source), test_reviews(id,text).
CORPUS_CTES = f"""
docs AS (SELECT doc_id AS id, text, source FROM documents),
cls AS (SELECT doc_id AS id,
               CAST(CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END AS INTEGER) AS class
        FROM labels),
pieces AS (
  SELECT d.id, u.p, u.k
  FROM docs d, unnest(regexp_extract_all(d.text, '[A-Za-z]+|[^A-Za-z]+')) WITH ORDINALITY AS u(p, k)),
near AS (
  SELECT *, lead(p, 1) OVER w AS n1, lead(p, 2) OVER w AS n2, lag(p, 1) OVER w AS b1, lag(p, 2) OVER w AS b2
  FROM pieces WINDOW w AS (PARTITION BY id ORDER BY k)),
kinds AS (
  SELECT id, k, p, coalesce({_pair_case('b1', 'p', 'n1')}, {_pair_case('b2', 'b1', 'p')}) AS goes_on,
         coalesce({_pair_case('p', 'n1', 'n2')}, {_kind_case('p')}) AS kind
  FROM near),
piece_labels AS (
  SELECT id, k,
         CASE WHEN goes_on IS NOT NULL THEN trim(repeat('I-' || goes_on || ' ', length(p)))
              WHEN kind IS NOT NULL THEN 'B-' || kind || repeat(' I-' || kind, length(p) - 1)
              ELSE trim(repeat('O ', length(p))) END AS lab
  FROM kinds),
tagged AS (
  SELECT d.id, d.text, d.source, string_agg(pl.lab, ' ' ORDER BY pl.k) AS BIO_anno
  FROM docs d JOIN piece_labels pl USING (id) GROUP BY d.id, d.text, d.source),
reviews AS (SELECT t.id, t.text, t.BIO_anno, c.class, t.source FROM tagged t JOIN cls c USING (id)),
test_reviews AS (SELECT d.id, d.text FROM docs d ANTI JOIN cls c USING (id))
"""


# CTEs that others read several times (or in every step of a recursion) are computed once
_ONCE = re.compile(r"^(\w*tok|tlab|tw|trw|tr|val|\w*em|emcnt|trans|reviews|test_reviews|tagged|rc|rl|qrc|qrl|vocab|\w*tchar"
                   r"|\w*path|qbio|marked|omarked|mtrain|mlog|mpr|mseen) AS \(", re.M)


def with_corpus(body: str, extra_ctes: str = "") -> str:
    ctes = CORPUS_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH RECURSIVE {_ONCE.sub(lambda m: m[1] + ' AS MATERIALIZED (', ctes)}\n{body.strip()}"
