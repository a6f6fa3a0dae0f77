"""Hard negatives, byte-pair encoding and ranked search against brute force and the installed library."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import documents, sf_dir
from pyspark.sql import functions as F
from tagloom.llm import bpe, hard_negatives, queries, ranked_search
from tagloom.llm.common import NO_SCORE, Best
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- hard negatives ----------------------------------------------------------------------

def brute_negatives(rows, anchors):
    """rows: (id, label, vector) in any order; anchors by id."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in rows:
        if i is None or not anchors(i):
            continue
        scores = [(dot(v, w), j, m) for j, m, w in rows]
        first = sorted([(s, j) for s, j, m in scores if m == label and j != i], key=key)[:5]
        for ps, p in first:
            fits = sorted([(s, j) for s, j, m in scores if m != label and 50 * ps <= 100 * s <= 95 * ps], key=key)[:3]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(fits)]
    return sorted(out, key=str)


def vectors(n, dim=6, seed=0):
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centre[rng.randrange(4)]
        rows.append((i, rng.randrange(4), [x + rng.gauss(0, 0.2) for x in c]))
    rows[10] = (10, rows[9][1], rows[9][2])                        # ties
    rows[12], rows[14] = rows[11], rows[11]                        # repeated rows, one id
    rows[20] = (None, 1, rows[20][2])                              # null id
    rows[22], rows[23] = (22, 2, rows[22][2][:3]), (23, 2, [])     # other lengths
    return rows


@pytest.mark.parametrize("block, tree", [(16384, 1024), (7, 3)])
def test_hard_negatives(spark, monkeypatch, block, tree):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    rows = [(i, m, [math.floor(256 * x) for x in v]) for i, m, v in vectors(300)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, label int, vector array<long>, slot string, score string")
    got = hard_negatives.mine(df.repartition(5), F.col("vec_id") % 3 == 0)
    want = brute_negatives(rows, lambda i: i % 3 == 0)
    assert len(want) > 500 and sorted(map(tuple, got.collect()), key=str) == want


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives.mine(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(50, 1, [1, 2])], "vec_id long, label int, vector array<long>")
    assert hard_negatives.mine(one, F.col("vec_id") == 50).count() == 0
    assert hard_negatives.mine(one, F.col("vec_id") == 51).count() == 0


def test_large_numbers_are_scored_exactly(spark):
    big = 1 << 27
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 2, [big * 9 // 10, 7]), (3, 2, [big * 9 // 10, 6]), (4, 2, [big, 2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    got = hard_negatives.mine(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows, lambda i: i == 0)


def test_rows_that_take_no_part(spark, tmp_path):
    rows = [(i, m, v) for i, m, v in vectors(120) if i is not None and len(v) == 6]
    bad = [(500, None, [1.0] * 6), (550, 1, None), (600, 1, [1.0] * 5 + [None]), (650, 1, [1.0] * 5 + [float("nan")]),
           (700, 1, [float("-inf")] + [1.0] * 5)]
    table = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>")
    got = queries.op11_hard_negatives(spark, sf_dir(spark, tmp_path, embeddings=table)).collect()
    clean = [(i, (m + 1) % 10 if i % 7 == 0 else m, [math.floor(256 * float(np.float32(x))) for x in v]) for i, m, v in rows]
    assert sorted(map(tuple, got), key=str) == brute_negatives(clean, lambda i: i % 50 == 0)


def test_bounds_leave_pairs_out():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (40, 8)) + 40 * np.eye(8)[k] for k in range(4)])
    points = np.floor(16 * points).astype(np.int64)
    block = hard_negatives.Block(list(range(160)), np.zeros(160, np.int64), points)
    high = np.full(160, np.inf)
    low = lambda: np.full(160, 16.0 * 16 * 1200)
    got = sorted((a, r, s) for at, row, sc in hard_negatives.scored(block, points, np.zeros(160, np.int64), True, low, high)
                 for a, r, s in zip(at.tolist(), row.tolist(), sc.tolist()))
    exact = points @ points.T
    assert got == [(a, r, int(exact[a, r])) for a in range(160) for r in range(160) if exact[a, r] >= low()[0]]


# --- byte-pair encoding ------------------------------------------------------------------

TEXTS = [None, "", " ", "Hello  WORLD it's we're they'll I'd 'tis ''s !'s 12 3½ x²", "a<|endoftext|>B <|startoftext|>c<|end", "Ǆ ẞ İstanbul ΣΑΣ é é ﬁ",
         "中文字符 日本語 한국어 한", "🙂👨‍👩‍👧 \x00\x01\x7f\x85　  end", "x" * 30000, "ab" * 20000, "word " * 20000, "it's" * 500,
         "Same text", "Same text", "-- ... ?!"]


def test_encoding_is_the_librarys(spark):
    lib = Tokenizer.from_file(PATH)
    docs = documents(spark, TEXTS, ids=[None, 1, 1] + list(range(3, len(TEXTS))))
    got, t = bpe.encode(docs.coalesce(1), PATH, name="found")
    back, d = bpe.decode(got.select("*", F.col(f"{t}.ids").alias("ids")), PATH, "ids", name="row")
    rows = back.select("doc_id", F.col("text").alias("was"), "score", f"{t}.n_tokens", bpe.as_array(F.col("ids")).alias("ids"),
                       F.col(f"{d}.text").alias("back")).collect()
    assert len(rows) == len(TEXTS)
    for r, text in zip(rows, TEXTS):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert r["was"] == text and r["score"] == "x"
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["back"] == lib.decode(ids, skip_special_tokens=False)


def test_encoding_an_empty_table(spark, tmp_path):
    docs = documents(spark, ["x"]).limit(0)
    assert queries.op12_bpe(spark, sf_dir(spark, tmp_path, documents=docs)).collect() == []


def test_digests_of_the_query(spark, tmp_path):
    lib = Tokenizer.from_file(PATH)
    got = queries.op12_bpe(spark, sf_dir(spark, tmp_path, documents=documents(spark, TEXTS))).collect()
    for r in got:
        ids = lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


PARTS = st.sampled_from(["'", "s", "re", "'ll", "t", "the", "ing", "aa", "ab", "é", "é", "中", "½", "7", " ", "\n", "!", "<|endoftext|>", "<|", "İ", "Σ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.lists(PARTS, max_size=20).map("".join)), max_size=5))
def test_any_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, at = bpe.load(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    lib = Tokenizer.from_file(PATH) if "lib" not in globals() else globals()["lib"]
    globals()["lib"] = lib
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_backtracking_takes_tokens_back():
    """Merges in which the longest match is a dead end, and one whose token its own text never gives."""
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "d", "a</w>", "b</w>", "c</w>", "d</w>"])}
    merges = ["a b", "c d</w>", "b c", "ab c", "b cd</w>", "a a"]
    for m in merges:
        vocab[m.replace(" ", "")] = len(vocab)
    v = bpe.Vocabulary(vocab, merges, "</w>")
    rank = {tuple(m.split(" ")): r for r, m in enumerate(merges)}

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (99, 0)
            if best[0] == 99:
                return tuple(vocab[p] for p in parts)
            parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]

    rng = random.Random(0)
    words = ["abcd", "aaaa", "aaa"] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert v.encode(words) == [plain(w) for w in words]


# --- ranked search -----------------------------------------------------------------------

def brute_ranks(docs, items, k=20):
    """docs: (doc_id, text), items: (item_id, text)."""
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    terms = lambda t: [w.translate(low) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    found = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in set(t))
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, t in found:
            tf, score = Counter(t), 0
            for w, times in asked.items():
                if tf[w]:
                    m = 100 - 25 + (25 * len(t) * n_docs) // total
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                scores.append((score, i))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def small_corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "日本", "delta9", "eps", "zeta", "eta", "theta", "iota"] + [f"w{i}" for i in range(60)]
    text = lambda m: " ".join(rng.choice(words[:10 + rng.randint(0, 60)]) for _ in range(m))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(60)]               # ties past the 20th
    docs += [(None, docs[5][1]), (3, docs[7][1]), (900, None), (901, ""), (902, "-- !"), (903, "alpha " * 30000)]
    items = [(i, text(rng.randint(1, 15))) for i in range(30)]
    items += [(5, docs[5][1]), (5, docs[5][1]), (31, None), (32, ""), (33, "unheard"), (None, "alpha beta beta"), (34, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_ranked_search(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    docs, items = small_corpus()
    d = spark.createDataFrame([(*r, "x", "x", 1) for r in docs], "doc_id long, text string, query string, score string, n int").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string")
    got = ranked_search.rank(d, b)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.rank(docs.limit(0), items).count() == 0
    assert ranked_search.rank(docs, items.limit(0)).count() == 0
    assert ranked_search.rank(docs, spark.createDataFrame([(1, "b")], "item_id long, text string")).count() == 0


def test_treap_gives_the_cells_and_their_maxima():
    rng = np.random.default_rng(1)
    grid = rng.integers(1, 1000, (13, 37)) * (rng.random((13, 37)) < 0.2)
    rows, cols = np.nonzero(grid)
    tree = ranked_search.Treap(rows, cols, grid[rows, cols], 37)
    for level in range(tree.height + 1):
        size = 1 << (tree.height - level)
        for r in range(13):
            for c in range(37):
                node = np.zeros(1, np.int64)
                for at in range(level):
                    shift = tree.height - 1 - at
                    node, best = tree.descend(at, node, np.array([(r >> shift & 1) * 2 + (c >> shift & 1)]))
                    if node[0] < 0:
                        best = np.zeros(1)
                        break
                else:
                    best = tree.levels[level][2][node]
                r0, c0 = r // size * size, c // size * size
                assert best[0] == grid[r0:r0 + size, c0:c0 + size].max()


def test_shards_and_groups_of_queries(monkeypatch):
    """Shards of a few cells, queries in small groups: the same results as in one."""
    monkeypatch.setattr(ranked_search, "SHARD_CELLS", 20)
    rng = np.random.default_rng(5)
    n, v = 200, 30
    sizes = rng.integers(0, 9, n)
    terms = [np.sort(rng.choice(v, s, replace=False)) for s in sizes]
    times = [rng.integers(1, 4, s) for s in sizes]
    ids = rng.permutation(n)
    batches = [pa.record_batch([pa.array(ids[a:a + 70]), pa.array(sizes[a:a + 70].astype(np.int64) + 1),
                                pa.array([list(t) for t in terms[a:a + 70]], pa.list_(pa.int32())),
                                pa.array([list(t) for t in times[a:a + 70]], pa.list_(pa.int32()))], names=list("abcd"))
               for a in range(0, n, 70)]
    seen = list(ranked_search.shards(batches))
    assert len(seen) > 20 and sorted(i for s in seen for i in s[0].tolist()) == list(range(n))
    query, row, mult = np.repeat(np.arange(6), 8), np.concatenate([rng.choice(v, 8, replace=False) for _ in range(6)]), rng.integers(1, 3, 48)
    best, exact = Best(6, 5), np.zeros((6, n), np.int64)
    place = {t: i for i, t in enumerate(ids.tolist())}
    for doc_ids, length, col, term, count in seen:
        if len(term):
            tree = ranked_search.Treap(term, col, count * 10 + term, max(v, len(doc_ids)))
            for q in range(0, 6, 2):
                part = (query == q) | (query == q + 1)
                ranked_search.search(tree, doc_ids, query[part], row[part], mult[part], best)
    for q in range(6):
        for d in range(n):
            at = place[d]
            for t, c in zip(terms[at], times[at]):
                exact[q, d] += sum(int(m) for r, m in zip(row[query == q], mult[query == q]) if r == t) * int(c * 10 + t)
        order = sorted(range(n), key=lambda d: (-exact[q, d], d))[:5]
        want = [(int(exact[q, d]), d) for d in order if exact[q, d] > 0]
        assert [(int(s), int(i)) for s, i in zip(best.score[q], best.id[q]) if s > NO_SCORE] == want
