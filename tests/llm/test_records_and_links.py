"""SimHash classes, WARC round trips and mixing rates, against brute force."""
import base64
import hashlib
import io
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from llm_fixtures import documents, sf_dir
from tagloom.llm import graph, mixing, queries, simhash, warc


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, distance):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_simhash_query(spark, tmp_path):
    rng = random.Random(1)
    texts = ["", None, " \n", "a", "A", "a b c d", "é É ß x y"]
    for _ in range(25):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            near = list(words)
            near[rng.randrange(len(near))] = "zz"
            texts.append("\n".join(near))
    ids = rng.sample(range(10_000), len(texts))
    texts.append(texts[10])
    ids.append(ids[10])                                            # a repeated row
    d = sf_dir(spark, tmp_path, documents=documents(spark, texts, ids))
    got = Counter(tuple(r) for r in queries.op9_simhash_near_dedup(spark, d).collect())
    fps = [brute_fingerprint(t) for t in texts]
    root = brute_classes(fps, 4)
    least = {r: min(i for i, q in zip(ids, root) if q == r) for r in set(root)}
    assert got == Counter((i, f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, root))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("limit", [1 << 22, 1 << 12])
def test_links_span_all_pairs(distance, limit):
    rng = np.random.default_rng(distance)
    fps = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    for _ in range(3):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, False)) for _ in fps], np.uint64)
        fps = np.concatenate([fps, fps[:len(flips)] ^ flips])
    fps = np.unique(np.concatenate([fps, np.array([0, 2**64 - 1], np.uint64)]))
    bits = 3
    masks = simhash.ball((distance + 1) // 2)
    links = []
    for shard in range(1 << bits):
        mine = np.isin(simhash.shard_of(fps, bits) ^ np.uint64(shard), simhash.shard_of(masks, bits))
        links += simhash.shard_links(shard, bits, fps[mine], distance, limit).tolist()
    at = {int(f): i for i, f in enumerate(fps)}
    label = simhash.forest(len(fps), np.array([[at[a], at[b]] for a, b in links], np.int64).reshape(-1, 2))
    assert label.tolist() == brute_classes([int(f) for f in fps], distance)


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = documents(spark, [text, text, text + " end", "other words here now", None, "", text], [5, 3, 4, 9, 8, None, 3])
    kept = simhash.keep_first(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter([3, 9, 8, None])
    assert kept[0].__fields__ == docs.columns
    assert simhash.keep_first(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
    label = {x: x for e in links for x in e if x is not None}
    for _ in label:
        for a, b in links:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if x != r}


# --- WARC --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b\r\nc", "same"), (3, None, "same"), (2, "u", "same"), (4, "u", ""), (9, "u", None), (5, "é", "é\r\n\r\nWARC/1.1\r\n"),
            (6, "u", "x" * 2_000_000), (None, "u", "same"), (None, None, "lone"), (3, None, "same")]
    d = sf_dir(spark, tmp_path, pages=pages(spark, rows))
    got = Counter(tuple(r) for r in queries.op10_warc(spark, d).collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        keep = max((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None)
        refers = None if page == keep else keep
        want[(page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    assert got == want


def test_warc_chunks_carry_digests(spark):
    body = bytes(range(32, 127)) * 1000
    manifest, folder = warc.archive(pages(spark, [(1, "u", body.decode())]))
    rows = sorted(warc.read(manifest, folder, chunk=7000).collect(), key=lambda r: r.chunk)
    whole = b""
    for i, r in enumerate(rows):
        whole += bytes(r.data)
        assert r.chunk == i and len(r.data) <= 7000
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(whole).digest()).decode()
    assert whole == body and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]


def test_warc_in_a_folder_of_the_callers(spark, tmp_path):
    from pyspark.errors import AnalysisException
    folder = f"{tmp_path}/kept here"
    table = pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", None)])
    warc.archive(table, folder=folder)
    manifest, where = warc.open_archive(spark, folder)
    assert sum(r.records for r in manifest.collect()) == 3
    got = {r.page_id: (r.record_type, r.refers_to, bytes(r.data)) for r in warc.read(manifest, where).collect()}
    assert got == {1: ("revisit", 2, b""), 2: ("response", None, b"ab"), 3: ("response", None, b"")}
    with pytest.raises(AnalysisException):
        warc.archive(table, folder=folder)


def test_warc_file_systems():
    from pyarrow import fs
    for name in ("/a/b", "file:/a/b", "file:///a/b"):
        files, path = warc.file_system(name)
        assert isinstance(files, fs.LocalFileSystem) and path == "/a/b"
    assert isinstance(warc.file_system("s3a://bucket/x?region=eu-west-1")[0], fs.S3FileSystem)
    assert warc.file_system("s3n://bucket/x?region=eu-west-1")[1] == "bucket/x"


def test_warc_min_size_empty_and_damage(spark):
    two = pages(spark, [(1, "u", "ab"), (2, "u", "ab")])
    manifest, folder = warc.archive(two, min_revisit_bytes=3)
    assert {r.record_type for r in warc.read(manifest, folder).collect()} == {"response"}
    manifest, folder = warc.archive(pages(spark, []))
    assert warc.read(manifest, folder).count() == 0
    record = warc.head(1, "u", 2, hashlib.sha1(b"ab").hexdigest(), None) + b"ab\r\n\r\n"
    import gzip
    assert [r[6] for r in warc.parse(io.BytesIO(gzip.compress(record)))] == [b"ab"]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(gzip.compress(record.replace(b"ab\r\n\r\n", b"ax\r\n\r\n")))))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(gzip.compress(record[:-8]))))


# --- mixing ------------------------------------------------------------------------------

def brute_rates(n, p, target, ridge=1e-3, steps=20_000):
    q = n[:, None] * p / n.sum()
    d = len(n)
    g = q.T @ q * d
    m = np.linalg.inv(g + np.trace(g) / len(g) * 1e-6 * np.eye(len(g)))
    r = np.ones(d)
    for _ in range(steps):
        r = np.maximum(0, r - 0.9 * (d * q @ (m @ (q.T @ r - target)) + ridge * (r - 1)))
    return r, q, m


def test_rates_match_projected_gradient(spark):
    rng = np.random.default_rng(3)
    n, p = rng.integers(0, 200, 60), rng.dirichlet([0.3] * 3, 60)
    member = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    target = np.array([0.6, 0.3, 0.1])
    rated, shares = mixing.fit_rates(member, target.tolist(), tolerance=1e-5)
    r = np.array([x.rate for x in sorted(rated.collect(), key=lambda x: x.doc_id)])
    want, q, m = brute_rates(n, p, target)
    assert (r >= 0).all() and np.abs(q.T @ r - q.T @ want).max() < 2e-3
    loss = lambda x: 0.5 * (q.T @ x - target) @ m @ (q.T @ x - target) + 0.5e-3 / len(n) * ((x - 1) ** 2).sum()
    assert loss(r) <= loss(want) + 1e-4
    assert r[n == 0] == pytest.approx(1.0)


@pytest.mark.parametrize("long", [1, 3])
def test_rates_meet_targets_beside_very_long_documents(spark, long):
    rng = np.random.default_rng(5)
    n = np.maximum(1, rng.lognormal(5, 1, 3000)).astype(int)
    n[:long] = 2_000_000
    kind = rng.choice(3, 3000, p=[0.5, 0.3, 0.2])
    kind[:long] = 1 + np.arange(long) % 2
    p = 0.97 * np.eye(3)[kind] + 0.01
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    member = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    target = np.array([0.92, 0.06, 0.02])
    rated, shares = mixing.fit_rates(member, target.tolist())
    r = np.array([x.rate for x in sorted(rated.collect(), key=lambda x: x.doc_id)])
    reached = (n[:, None] * p / n.sum()).T @ r
    assert (r >= 0).all() and reached == pytest.approx(np.array(shares), abs=1e-9)
    assert np.abs(reached - target).max() <= 1e-4


def test_mix_tells_the_gap(spark):
    texts = ["red apple pear"] * 10 + ["iron steel bolt"] * 10
    labels = spark.createDataFrame([(i, "fruit" if i < 10 else "metal") for i in range(20)], "doc_id long, label string")
    met = mixing.mix(documents(spark, texts), labels, {"fruit": 3, "metal": 1}).schema["rate"].metadata
    assert met["gap"] <= 1e-4 and met["targets"] == {"fruit": 0.75, "metal": 0.25} and met["shares"]["fruit"] == pytest.approx(0.75, abs=1e-4)
    with pytest.warns(UserWarning, match="miss the target"):      # posteriors are never 0 and 1
        missed = mixing.mix(documents(spark, texts), labels, {"fruit": 1}).schema["rate"].metadata
    assert missed["gap"] > 1e-4


def test_mix_end_to_end(spark):
    texts = ["red apple pear"] * 20 + ["iron steel bolt"] * 20 + ["red iron", None, "", "unseen words"]
    docs = documents(spark, texts, [*range(40), None, 41, 41, 43])
    labels = spark.createDataFrame([(i, "fruit" if i < 20 else "metal") for i in range(0, 40, 2)] + [(None, "fruit"), (1, None)], "doc_id long, label string")
    rows = mixing.mix(docs, labels, {"fruit": 3, "metal": 1}).collect()
    assert len(rows) == len(texts) and rows[0].counts == "x"
    assert sorted(str(r.text) for r in rows) == sorted(map(str, texts))
    assert "text" not in mixing.mix(docs, labels, {"fruit": 3, "metal": 1}, keep_text=False).columns
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 41)}
    assert by[1].p[0] > 0.7 and by[21].p[1] > 0.7 and by[43].p == pytest.approx([0.5, 0.5])
    total = sum(r.n_tokens for r in rows)
    assert sum(r.rate * r.n_tokens * r.p[0] for r in rows) / total == pytest.approx(0.75, abs=0.02)
    assert by[1].rate > 1 > by[21].rate >= 0
    assert all(r.rate == pytest.approx(1.0) and r.n_tokens == 0 for r in rows if r.doc_id == 41)


def test_mix_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label string")
    assert [r.rate for r in mixing.mix(documents(spark, ["a b", None]), none, {"x": 1}).collect()] == [1.0, 1.0]
    assert mixing.mix(documents(spark, []), none, {"x": 1}).count() == 0


def test_mix_keeps_columns_of_its_own_names(spark):
    texts = ["red apple pear"] * 6 + ["iron steel bolt"] * 6 + [None]
    names = ("n_tokens", "p", "rate", "mix_n", "mix_bucket", "mix_l0", "mix_at", "mix_z", "mix_e", "q0", "r", "label")
    docs = documents(spark, texts).select("doc_id", "text", *[F.lit(c).alias(c) for c in names])
    labels = spark.createDataFrame([(i, "fruit" if i < 6 else "metal") for i in range(12)], "doc_id long, label string")
    out = mixing.mix(docs, labels, {"fruit": 3, "metal": 1})
    assert out.columns == [*docs.columns, "n_tokens_", "p_", "rate_"]
    for r in out.collect():
        assert all(r[c] == c for c in names) and r["n_tokens_"] == (3 if r.text else 0)
    assert out.agg(F.sum("rate_")).first()[0] > 0


def test_labels_without_a_target_are_one_domain(spark):
    texts = ["red apple pear"] * 6 + ["iron steel bolt"] * 6 + [f"w{i} w{i} x{i}" for i in range(80)]
    labels = spark.createDataFrame([(i, "fruit" if i < 6 else "metal" if i < 12 else f"stray {i}") for i in range(92)], "doc_id long, label string")
    out = mixing.mix(documents(spark, texts), labels, {"fruit": 3, "metal": 1})
    told = out.schema["rate"].metadata
    assert set(told["shares"]) == {"fruit", "metal", "other"} and told["targets"]["other"] == 0


def test_posteriors_match_naive_bayes(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab[20 * (i % 2):20 * (i % 2) + 25], 12)) for i in range(60)] + ["", None, "Unknown", "w1  W2\tw3"]
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, label string")
    docs = documents(spark, texts)
    domains, model = mixing.word_model(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: (r.n_tokens, r.p) for r in mixing.posteriors(docs, domains, model).collect()}
    place = {r.w: r.b for r in spark.createDataFrame([(v,) for v in {w for t in texts if t for w in t.lower().split()}], "w string")
             .select("w", mixing.bucket(F.col("w")).alias("b")).collect()}
    counts = {k: {} for k in "ab"}
    for i in range(40):
        for b in {place[w] for w in texts[i].lower().split()}:
            counts["ab"[i % 2]][b] = counts["ab"[i % 2]].get(b, 0) + 1
    for i, t in enumerate(texts):
        ws, z = (t or "").lower().split(), {}
        for k in "ab":
            total = sum(counts[k].values()) + 0.5 * mixing.BUCKETS
            z[k] = sum(math.log((counts[k].get(place[w], 0) + 0.5) / total) for w in ws
                       if counts["a"].get(place[w], 0) + counts["b"].get(place[w], 0)) / math.sqrt(max(1, len(ws)))
        want = 1 / (1 + math.exp(z["b"] - z["a"]))
        assert got[i][0] == len(ws) and got[i][1][0] == pytest.approx(want, abs=1e-9)
