"""Trained models: held-out accuracy, determinism, edge cases."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import documents, sf_dir
from tagloom.llm import common, language_id, quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_span_hash_and_runs():
    data, offs = common.utf8(__import__("pyarrow").array(["ab ab", None, "", "ab"]))
    cls = (data != 32).astype(np.int8)
    starts, ends = common.runs(cls, offs)
    assert list(zip(starts, ends)) == [(0, 2), (3, 5), (5, 7)]         # no run crosses a text edge
    h = common.SpanHash(data)(starts, ends)
    assert len(set(h.tolist())) == 1 and int(h[0]) == common.string_hash(b"ab")


def test_quality_held_out(spark):
    rows = queries.op5_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_held_out(spark):
    rows = queries.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_edges(spark, tmp_path):
    texts = ["the quick brown fox"] * 9 + ["der schnelle braune fuchs"] * 9 + [None, "", "123 !?", "𝒳", "the fox", "a" * 100_000]
    langs = ["en"] * 9 + ["de"] * 9 + ["en", "de", "de", None, None, None]
    d = sf_dir(spark, tmp_path / "a", documents=documents(spark, texts, langs=langs))
    got = {r.doc_id: r for r in queries.op8_language_id(spark, d).collect()}
    assert [got[i].lang_pred for i in (18, 19, 20)] == ["und"] * 3 and got[21].lang_pred in ("en", "de") and got[22].lang_pred == "en"
    d = sf_dir(spark, tmp_path / "b", documents=documents(spark, ["some text", None], langs=[None, None]))
    assert {r.lang_pred for r in queries.op8_language_id(spark, d).collect()} == {"und"}
    d = sf_dir(spark, tmp_path / "c", documents=documents(spark, []))
    assert queries.op8_language_id(spark, d).count() == 0


def test_document_frequency_counts_all_texts(spark):
    texts = ["abc abc", "abd", None, "", "é"] * 300
    df, n = language_id.document_frequency(documents(spark, texts).repartition(3))
    assert n == 1500
    want = np.zeros(language_id.BUCKETS, int)
    for t in texts:
        bucket, _ = language_id.ngrams(*common.utf8(__import__("pyarrow").array([t])))
        want[np.unique(bucket)] += 1
    assert (df == want).all()


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=language_id.softmax(z)) for z in logits])
    assert language_id.temperature(logits * 3, y) == pytest.approx(3, rel=0.15)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(1)
    vocab = [f"{a}{b}" for a in "bcdfghk" for b in "aeiou"]
    texts, toxic = [], []
    for i in range(600):
        words = [rng.choice(vocab) + rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "jerk" + rng.choice(vocab)])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = documents(spark, texts, langs=["en", "de", None] * 200)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 3], "doc_id long, label int")
    rows = {r.doc_id: r for r in toxicity.judge(docs.select("doc_id", "lang", "text"), labels).collect()}
    held = [i for i in range(600) if i % 3 == 0]
    assert sum((rows[i].score >= 0.7) == bool(toxic[i]) for i in held) / len(held) > 0.95
    assert len({(rows[i].lang, rows[i].threshold) for i in rows}) <= 3
    assert sum(rows[i].toxic == bool(toxic[i]) for i in held) / len(held) > 0.95


def test_pooling_matches_a_plain_loop():
    model = toxicity.fresh(3)
    rng = np.random.default_rng(0)
    lengths = [0, 1, 2, 3, 0, 17, 1, 0]
    rows = rng.integers(0, toxicity.BUCKETS, (sum(lengths), 3)).astype(np.int32)
    first = np.cumsum([0] + lengths)
    got = toxicity.pooled(model, rows, first)
    for i, n in enumerate(lengths):
        x = toxicity.embed(model["e"], rows[first[i]:first[i + 1]]) if n else np.empty((0, toxicity.DIM))
        at = 0
        for k, w in enumerate(toxicity.WIDTHS):
            best = np.zeros(toxicity.FILTERS)
            for t in range(n - w + 1):
                z = sum(x[t + j] @ model["taps"][:, at + j * 8:at + (j + 1) * 8] for j in range(w))
                best = np.maximum(best, z)
            assert np.allclose(got[i, k * 8:(k + 1) * 8], best, atol=1e-5)
            at += w * toxicity.FILTERS


@pytest.mark.parametrize("query", ["op5_quality_classifier", "op7_toxicity"])
def test_models_without_labels(spark, tmp_path, query):
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], LABELS)
    d = sf_dir(spark, tmp_path / "a", documents=documents(spark, ["text here", None, "", "w " * 50_000], [1, None, 2, 2]), labels=none)
    rows = queries.QUERIES[query](spark, d).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    d = sf_dir(spark, tmp_path / "b", documents=documents(spark, []), labels=none)
    assert queries.QUERIES[query](spark, d).count() == 0


def test_sample_is_bounded_and_stable(spark):
    docs = documents(spark, ["t"] * 2000).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(5, 0)] * 500, "doc_id long, label int")
    a, shares = common.sample_by_class(docs, labels, 100)
    b, _ = common.sample_by_class(docs.repartition(7), labels.repartition(5), 100)
    ids = {r.doc_id for r in a.collect()}
    assert ids == {r.doc_id for r in b.collect()} and 120 < len(ids) < 280
    assert shares[1] == pytest.approx(0.1) and shares[0] == pytest.approx(0.1)


def test_ftrl_scores_by_sparse_dot_product():
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["junk", "###", "spam"]) for _ in range(30)) for i in range(200)]
    w = quality_classifier.fit(texts, np.arange(200) % 2.0, np.ones(200))
    score = quality_classifier.scorer(type("B", (), {"value": w}))
    data, offs = common.utf8(__import__("pyarrow").array(["good nice fine", "### junk", "", None]))
    got = score(data, offs)[0]
    assert got[0] > 0.8 > 0.2 > got[1] and got[2] == got[3]


def plain_grams(text):
    """Counts of a text's word n-grams, not hashed; a bigram of one word twice has no word."""
    words = re.findall("[0-9A-Za-z\x80-\U0010FFFF]+|[^0-9A-Za-z\x80-\U0010FFFF \t-\r]+", text or "")
    return Counter(words) + Counter(("twice",) if a == b else (a, b) for a, b in zip(words, words[1:]))


def plain_regression(texts, y, weight, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.1, scale=32.0):
    """FTRL-proximal logistic regression, one coordinate at a time; returns the score of a text."""
    grams = [plain_grams(t) for t in texts]
    seen = Counter(g for row in grams for g in row)
    z, n = Counter(), Counter()

    def weight_of(g):
        return 0.0 if abs(z[g]) <= l1 else -(z[g] - np.sign(z[g]) * l1) / ((beta + n[g] ** 0.5) / alpha + l2)

    def vector(row, known):
        total = max(1, sum(row.values()))
        return {g: c * scale / total for g, c in row.items() if not known or seen[g] >= 3} | {None: 1.0}

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            x = vector(grams[i], True)
            w = {g: weight_of(g) for g in x}
            p = 1 / (1 + np.exp(-sum(w[g] * v for g, v in x.items())))
            for g, v in x.items():
                step = weight[i] * (p - y[i]) * v
                z[g] += step - ((n[g] + step * step) ** 0.5 - n[g] ** 0.5) / alpha * w[g]
                n[g] += step * step
    return lambda text: 1 / (1 + np.exp(-sum(weight_of(g) * v for g, v in vector(plain_grams(text), False).items())))


def test_quality_scores_are_the_plain_regressions(spark):
    """Fit and scores against one dictionary entry an n-gram: nulls, empty, repeated, very long and non-ASCII texts."""
    rng = random.Random(6)
    vocab = [["good", "fine", "näher", "the", "of", "3rd"], ["junk", "###", "spam", "the", "of", "!!"]]
    texts = [" ".join(rng.choice(vocab[i % 2] + ["it", "a", "was"]) for _ in range(rng.randint(0, 25))) for i in range(80)] + ["", "spam spam spam"]
    y, weight = np.arange(len(texts)) % 2 == 0, np.where(np.arange(len(texts)) % 2, 0.5, 1.0)
    want = plain_regression(texts, y.astype(float), weight)
    weights = quality_classifier.fit(texts, y.astype(float), weight)
    asked = [*texts, None, "", "new words only", "good good\nfine...of ###!!", "näher " * 30_000 + "junk", *texts[:5]]
    out, name = quality_classifier.score(documents(spark, asked).repartition(3), weights)
    got = {r.doc_id: r[name].score for r in out.collect()}
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        assert got[i] == pytest.approx(want(text), abs=2e-5)
    assert max(got.values()) > 0.9 and min(got.values()) < 0.1


def test_ids_without_a_fold(spark, tmp_path):
    """A null id is not held out, and of a repeated id the same text is sampled in any layout."""
    rows = spark.createDataFrame([(None, "a b c"), (5, "good text here")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    d = sf_dir(spark, tmp_path, documents=rows, labels=labels)
    for q in (queries.op5_quality_classifier, queries.op7_toxicity, queries.op8_language_id):
        got = {r["doc_id"]: r for r in q(spark, d).collect()}
        assert got[None]["held_out"] is False and len(got) == 2
    texts = spark.createDataFrame([(1, t) for t in ("aaaa", "bbbb", "cccc", "d", None)], "doc_id long, text string")
    label = spark.createDataFrame([(1, "x")], "doc_id long, label string")
    for n in (1, 2, 3, 5, 7):
        sample, _ = common.sample_by_class(texts.repartition(n), label, 10)
        assert [r["text"] for r in sample.collect()] == ["cccc"]


def test_stray_languages_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, "the cat sat on that mat", "en") for i in range(20)] + [(50 + i, "der hund und die katze", "de") for i in range(20)]
    rows += [(200 + i, f"zq{i}", f"stray{i}") for i in range(30)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, label string")
    languages, weights = language_id.train(learn)
    assert languages == ["de", "en"] and weights.shape[1] == 2


def test_stray_languages_share_a_cutoff(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LANGUAGES", 1)
    rows = [(i, lang, 0.9 if i % 2 else 0.1) for i, lang in enumerate(["en"] * 100 + ["de"] * 80 + ["xx"] * 4)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, label int")
    by, whole = toxicity.thresholds(scored, labels)
    assert list(by) == ["en"] and 0.1 < whole < 0.91
