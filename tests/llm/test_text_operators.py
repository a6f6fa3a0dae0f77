"""Operators on single texts, against brute force."""
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from llm_fixtures import documents, sf_dir
from tagloom.llm import decontaminate, line_dedup, pii, quality_rules, queries

LABELS = "doc_id long, quality int, toxic int"
EDGE = ["", None, "   \n\t ", "a", "a" * 200_000, "é𝒳 ü x", "x\r\ny\x0bz", "\n\n\n"]


def rng_text(rng, vocab, n):
    return " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


# --- quality rules -----------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if wins[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counts_and_base(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["a", "b", "é𝒳", "##", "x|y", "word"]
    texts = EDGE + [rng_text(rng, vocab[:k], n) for k in (1, 2, 4, 6) for n in (5, 19, 20, 60, 400)] + ["l one\n" * 5]
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    d = sf_dir(spark, tmp_path, documents=documents(spark, texts, ids), labels=spark.createDataFrame([(7, 1, 0), (None, 1, 0), (100, None, None)], LABELS))
    got = Counter(tuple(r) for r in queries.op4_quality_rules(spark, d).collect())
    want = Counter()
    for i, t in zip(ids, texts):
        c = brute_counts(t)
        bad = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want[(i, *c, bad, not bad)] += 1
    assert got == want


def test_quality_empty_tables(spark, tmp_path):
    d = sf_dir(spark, tmp_path, documents=documents(spark, []), labels=spark.createDataFrame([], LABELS))
    assert queries.op4_quality_rules(spark, d).count() == 0


def test_binomial_tail_and_choice():
    want = sum(math.comb(50, i) * 0.1 ** i * 0.9 ** (50 - i) for i in range(4))
    assert quality_rules.binomial_tail(3, 50, 0.1) == pytest.approx(want)
    rules = {(r, i): (0, 0) for r, (_, _, c) in quality_rules.RULES.items() for i in range(len(c))}
    few = {"en": {"good": 50, "bad": 9} | rules | {("symbols_per_word", 0): (0, 9)}}
    assert quality_rules.choose(few, 0.04, 0.05) == {"en": {}}                  # too few to certify
    many = {"en": {"good": 5000, "bad": 9} | rules | {("symbols_per_word", 0): (0, 5), ("symbols_per_word", 1): (0, 9),
                                                      ("symbols_per_word", 2): (400, 9)}}
    assert quality_rules.choose(many, 0.04, 0.05)["en"] == {"symbols_per_word": 3}


def test_certified_rules_bound_false_rejections(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    good = [rng_text(rng, vocab, 30) for _ in range(2500)]
    bad = [" ".join(rng.choice(vocab) + "$$$" for _ in range(30)) for _ in range(300)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 2500), 0) for i in range(2800)], LABELS)
    judged, v = quality_rules.judge(docs, labels)
    kept = {r["doc_id"] for r in judged.where(f"{v}.kept").select("doc_id").collect()}
    assert len(kept & set(range(2500))) >= 2400 and not kept & set(range(2500, 2800))


# --- personal data -----------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out, counts = [], []
    for kind, pattern in PATTERNS.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
            n += 1
        counts.append(n)
    return counts, out


def test_pii_base_spans(spark, tmp_path):
    rng = random.Random(3)
    parts = ["a@b.c", "%x@d.e", ".@d.e", "1.2.3.4", ".5.6.7.8", "300.1.1.1", "0001.2.3.4", "4785380592391139", "4785 3805-9239 1139",
             "+1 (453) 555-6570", "+12", "+", "@", "é", "𝒳", " ", "\n", "-", "x", "1234567890123456", "tel: ", "(212) 555-0199", "me (at) x (dot) com"]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["1.1.1.1 " * 500, "9" * 20_000, "x@" * 500 + "a" * 20_000, "+1" + "(0" * 2000]
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    d = sf_dir(spark, tmp_path, documents=documents(spark, texts, ids))
    rows = queries.op1_pii(spark, d).collect()
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    want = Counter()
    for i, t in zip(ids, texts):
        counts, spans = brute_spans(t)
        want[(i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert got == want
    by = dict(zip(ids, texts))
    for r in rows:                                         # base spans stay among all spans
        if r.doc_id not in (None, 7):
            assert set(brute_spans(by[r.doc_id])[1]) <= set(r.spans.split(","))


def labelled_text(rng):
    """A text and the (kind, value) of the personal data in it, besides numbers that are not."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: rng.choice(["jane", "max", "li", "ana.b", "o-k", "zoë"[:2]]) + d(2)

    def luhn(head, n):
        body = head + d(n - len(head) - 1)
        for last in "0123456789":
            if sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(body + last))) % 10 == 0:
                return body + last

    def amex():
        c = luhn(rng.choice(["34", "37"]), 15)
        return rng.choice([c, f"{c[:4]} {c[4:10]} {c[10:]}", f"{c[:4]}-{c[4:10]}-{c[10:]}"])

    phone = lambda: rng.choice(["212", "415", "646", "303"]) + rng.choice("-. ") + rng.choice(["555", "482", "739"]) + "-" + d(4)
    makers = [
        (0, lambda: f"{name()} (at) {rng.choice(['mail', 'work', 'uni-x'])} (dot) {rng.choice(['org', 'com', 'de', 'fr'])}"),
        (0, lambda: f"{name()}[at]{rng.choice(['gmail', 'gmx', 'firm'])}[dot]{rng.choice(['com', 'net', 'es'])}"),
        (0, lambda: f"{name()} dot {name()} (at) example.org"),
        (3, phone), (3, phone), (3, lambda: f"({rng.choice(['212', '415'])}) {rng.choice(['555', '482'])}-{d(4)}"),
        (3, lambda: f"{rng.choice(['123', '321', '456'])}-{rng.choice(['45', '67'])}-{rng.randint(1000, 9999)}"),
        (3, lambda: f"0{rng.choice(['30', '89', '221'])} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}"),
        (2, amex)]
    other = [lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
             lambda: f"order {d(9)}", lambda: f"version {d(2)}.{d(3)}.{d(4)}", lambda: f"{d(3)}.{d(5)}", lambda: f"id {d(12)}", lambda: f"800-555-{d(4)}"]
    cue = {0: ["write to", "mail:", "", ""], 3: ["call", "tel:", "", "", "or", "fax"], 2: ["card", "amex", "", ""]}
    out, found = "", []
    for _ in range(rng.randint(1, 9)):
        out += " ".join(rng.choice(["the", "red", "house", "ist", "grün"]) for _ in range(rng.randint(0, 4))) + rng.choice([" ", ", "])
        if rng.random() < 0.3:
            out += rng.choice(other)() + rng.choice([" ", ", "])
            continue
        kind, make = rng.choice(makers)
        out += rng.choice(cue[kind]) + " "
        value = make()
        found.append((kind, len(out), len(out) + len(value)))
        out += value + rng.choice([" ", ", ", " " + "10.0.0.1 " if rng.random() < 0.2 else " "])
    return out, found


def test_pii_recall_of_added_spans(spark):
    rng = random.Random(12)
    made = [labelled_text(rng) for _ in range(1500)]
    rows = pii.find(documents(spark, [t for t, _ in made])).collect()
    hit = total = extra = 0
    for r in rows:
        want = set(made[r.doc_id][1])
        base = {(x.k, x.s, x.e) for x in r.base}
        got = {(x.k, x.s, x.e) for x in r.spans} - base
        total += len(want)
        hit += len(want & got)
        extra += len(got - want)
        assert not any(s < b and a < e for _, s, e in base for _, a, b in got)     # outside the base
    assert total > 3000 and hit / total >= 0.9, (hit, total)
    assert extra / (hit + extra) <= 0.1, (extra, hit)


def test_pii_spans_beside_each_other(spark):
    texts = ["212-555-0199 212-555-0198 212-555-0197", "212-555-0199, 212-555-0198", "10.0.0.1 212-555-0199", "212-555-0199 10.0.0.1 212-555-0198 a@b.cd"]
    for r in pii.span_rows(documents(spark, texts)).collect():
        t = texts[r.doc_id]
        assert [t[x.s:x.e] for x in r.cand] == re.findall(r"212-555-019[0-9]", t)


def test_pii_is_linear_in_one_text(spark):
    seconds = []
    for n in (20_000, 40_000, 80_000):
        docs = documents(spark, ["a 1.1.1.1 b " * n])
        t = time.time()
        r = pii.span_rows(docs).selectExpr("size(base) n", "base[size(base) - 1].e e").first()
        seconds.append(time.time() - t)
        assert (r.n, r.e) == (n, 12 * n - 3)
    assert seconds[2] < 2.6 * seconds[1] + 2


def test_running_values(spark):
    rng = random.Random(2)
    sizes = [0, 1, 31, 32, 33, 1023, 1024, 1025, 32768, 32769, 70000]
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, v array<long>")
    sums = {r.i: r.o for r in pii.running(df, "v", "o", lambda a, b: a + b, 0).collect()}
    most = {r.i: r.o for r in pii.running(df, "v", "o", lambda a, b: F.greatest(a, b), 0).collect()}
    for i, v in rows:
        assert sums[i] == list(itertools.accumulate(v)) and most[i] == list(itertools.accumulate(v, max))


def test_pii_empty(spark, tmp_path):
    d = sf_dir(spark, tmp_path, documents=documents(spark, []))
    assert queries.op1_pii(spark, d).count() == 0


def test_em_finds_the_reliable_labeler():
    truth = [((1, 0, 0, 1), False, 40.0), ((1, 0, 0, -1), False, 5.0), ((-1, 0, 0, -1), False, 80.0), ((1, 0, 0, 1), True, 30.0)]
    model = pii.reliabilities(truth)
    assert pii.posterior(model, (1, 0, 0, 1)) > 0.9 > 0.1 > pii.posterior(model, (-1, 0, 0, -1))


# --- decontamination ---------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leak_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(text, items):
    words, hit, found = leak_words(text), set(), set()
    for key, item in items:
        w = leak_words(item)
        for j in range(max(min(len(w), 1), len(w) - 12)):
            win = w[j:j + 13]
            for i in range(len(words) - len(win) + 1):
                if words[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(key)
    ids = sorted(str(k) for k in found if k is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["Aa", "b", "c", "é", "1x"]
    items = [(1, rng_text(rng, vocab, 20)), (10, rng_text(rng, vocab, 13)), (2, "b c Aa"), (3, ""), (4, None), (None, "é é é 1x"), (2, "c c c c b b")]
    texts = EDGE + [rng_text(rng, vocab + ["zz"] * k, n) for k in (0, 3, 30) for n in (1, 12, 40, 300)]
    texts += ["zz " * 40 + items[0][1].upper() + " zz", items[1][1] + "\n" + items[1][1], items[0][1][:30]]
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    d = sf_dir(spark, tmp_path, documents=documents(spark, texts, ids), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = Counter(tuple(r) for r in queries.op3_benchmark_decontamination(spark, d).collect())
    assert got == Counter((i, *brute_leaks(t, items)) for i, t in zip(ids, texts))


def test_decontamination_cuts_and_empties(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = documents(spark, ["x " * 200 + "One, two: THREE four" + " y" * 3, "one two three four", None, "clean text"])
    rows = {r.doc_id: r for r in decontaminate.clean(docs, bench).collect()}
    assert set(rows) == {0, 2, 3} and rows[2].text is None and rows[3].text == "clean text"
    assert rows[0].text == "x " * 200 + " y" * 3 and rows[0].n_chars == len(rows[0].text)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == 4
    assert decontaminate.clean(documents(spark, []), bench).count() == 0


@pytest.mark.parametrize("symbols,n,seed", [(1, 40, 0), (2, 300, 1), (5, 1000, 2), (300, 2000, 3)])
def test_fm_index(symbols, n, seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0 if symbols > 1 else 1, symbols + 1, n)
    seq[0], seq[-1] = 0, 0
    index = decontaminate.FmIndex(seq, symbols)
    for m in (1, 2, 4):
        for _ in range(20):
            i = int(rng.integers(1, n - m))
            phrase = seq[i:i + m]
            if (phrase == 0).any():
                continue
            lo, hi = index.search(np.concatenate([np.zeros(13 - m, np.int64), phrase])[None, :])
            want = [p for p in range(n - m + 1) if (seq[p:p + m] == phrase).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


# --- line dedup --------------------------------------------------------------------------

def masked(line):
    w = line.split()
    fields = [bool(re.search("[0-9]", x)) for x in w]
    return tuple("*" if f else x for f, x in zip(fields, w)) if w and sum(fields) <= 0.3 * len(w) + 1e-9 else tuple(w)


def brute_dedup(docs):
    """Lines lost by each document: star clusters in leaves, all but the least document lose them."""
    where = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if line.split():
                where.setdefault(masked(line), set()).add(i)
    return where


def test_line_dedup(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta"
    texts = [f"{base}\nunique one here\nCall 555 now please thanks", f"{base}\nother line of mine\nCall 777 now please thanks",
             base.replace("theta", "iota") + "\nlast words of it", "a b\na b", None, "", "solo line stays put", "a b"]
    rows = {r.doc_id: r for r in line_dedup.dedup(documents(spark, texts), report=True).collect()}
    assert rows[0].text == texts[0]
    assert rows[1].text == "other line of mine" and rows[1].line_report.n_dropped == 2
    assert rows[2].text == "last words of it"                     # a similar line, not an equal one
    assert [rows[i].text for i in (3, 4, 5, 6)] == [texts[i] for i in (3, 4, 5, 6)]
    assert rows[7].text == ""                                     # short lines take part as exact repeats
    assert rows[0].n_chars == len(texts[0]) and rows[0].found == "x"


def test_line_dedup_exact_repeats_go_once(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["v"]
    lines = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8))) for _ in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(documents(spark, texts)).collect()}
    where = brute_dedup(enumerate(texts))
    for line, ids in where.items():
        stay = {i for i in ids if line in map(masked, got[i].split("\n"))}
        assert stay <= {min(ids)}
    for i, t in enumerate(texts):                                  # what stays is a subsequence of lines
        it = iter(t.split("\n"))
        assert not got[i] or all(x in it for x in got[i].split("\n"))
    assert vocab


def test_line_dedup_nulls_repeats_and_empty(spark):
    texts = ["one two three four"] * 4
    rows = line_dedup.dedup(documents(spark, texts, [None, 5, 5, 9])).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(
        [(None, texts[0]), (5, texts[0]), (5, texts[0]), (9, "")], key=str)
    assert line_dedup.dedup(documents(spark, [])).count() == 0


def test_large_leaf_gives_the_same_templates(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_LEAF", 4)
    texts = [f"a b c {x} e f g {y} i" for x in "pqrst" for y in "klmno"] + ["a b c p e f g k i"]
    got = {r.doc_id: r.text for r in line_dedup.dedup(documents(spark, texts)).collect()}
    assert got[25] == "" and got[0] == texts[0]


def leader_templates(rows):
    """Each line joins the first line, in order, that opened a template and is 70 % equal, one after another."""
    out, leads = [], []
    for i, row in enumerate(rows):
        at = next((j for j in leads if sum(a == b for a, b in zip(rows[j], row)) * 10 >= 7 * len(row)), i)
        leads += [i] * (at == i)
        out.append(at)
    return out


def test_template_of_is_the_plain_rule_at_every_length(monkeypatch):
    rng = np.random.default_rng(3)
    for step, pairs in ((7, 16), (2048, 1 << 22)):
        monkeypatch.setattr(line_dedup, "STEP", step)
        monkeypatch.setattr(line_dedup, "PAIRS", pairs)
        for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 20, 37):
            base = rng.integers(0, 3, (12, n))
            rows = np.where(rng.random((150, n)) < 0.25, rng.integers(0, 3, (150, n)), base[rng.integers(0, 12, 150)]).astype(np.uint32)
            rows[:, :3] = 1
            assert line_dedup.template_of(rows).tolist() == leader_templates(rows.tolist())


def test_leaf_above_the_limit_drops_what_it_drops_below(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    # one template whose words vary in the tokens 4-8, and lines of the same leaf that are near none or few
    lines = [f"Posted by user {word()} in town on our site today" for _ in range(60)]
    lines += [f"Posted by user {' '.join(rng.choice('klm') for _ in range(7))}" for _ in range(60)]
    texts = ["\n".join(lines[i::40]) for i in range(40)] + ["\n".join(rng.sample(lines, 3)) for _ in range(5)]
    docs = documents(spark, texts)
    below = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    monkeypatch.setattr(line_dedup, "MAX_LEAF", 16)
    above = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert above == below
    hot = [i for i, t in above.items() if "on our site" in t]
    assert len(hot) == 1


def test_only_lines_with_possible_neighbours_take_rounds(spark):
    rng = np.random.default_rng(4)
    rows, lone = [], set()
    for n in (2, 5, 9, 40):
        base = rng.integers(1, 1 << 31, (30, n)).astype(np.uint32)                # near to nothing but by chance
        base[:, :min(3, n - 1)] = 7
        base[20:] = np.where(rng.random((10, n)) < 0.15, 5, base[19])             # near one another
        lone |= {(n, k) for k in range(19)} if n == 40 else set()
        rows += [(n, k, n * 100 + k, bytearray(r.tobytes())) for k, r in enumerate(base)]
    lines = spark.createDataFrame([(n, line, t) for n, _, line, t in rows], "leaf long, line long, tokens binary").repartition(3)
    got = {(r.leaf, r.line - 100 * r.leaf) for r in line_dedup.with_neighbours(lines).collect()}
    for n, k, _, t in rows:
        mine = np.frombuffer(t, np.uint32)
        if any(m == n and j != k and (np.frombuffer(o, np.uint32) == mine).mean() >= 0.7 for m, j, _, o in rows):
            assert (n, k) in got
    assert not lone & got


def test_line_dedup_across_documents(spark, monkeypatch):
    """Against a plain restatement: a template in two documents or more stays in the least one alone."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bases = [["Say", "it", "so", *(word() for _ in range(9))] for _ in range(25)]
    texts, names = [], []
    for _ in range(50):
        picks = [rng.randrange(25) for _ in range(rng.randint(0, 4))] if rng.random() < 0.8 else []
        lines = []
        for b in picks:
            line = list(bases[b])
            line[rng.randint(3, 11)] = word()                     # any two lines of a template share 10 of 12 tokens
            lines.append(" ".join(line))
        own = [" ".join(word() for _ in range(rng.randint(4, 8))) for _ in range(2)]
        names.append([*picks, None, None])
        texts.append("\n".join(lines + own))
    homes = {}
    for i, picks in enumerate(names):
        for b in set(picks) - {None}:
            homes.setdefault(b, []).append(i)
    want = {i: "\n".join(x for x, b in zip(t.split("\n"), names[i]) if b is None or min(homes[b]) == i) for i, t in enumerate(texts)}
    for most in (1 << 15, 8):
        monkeypatch.setattr(line_dedup, "MAX_LEAF", most)
        assert {r.doc_id: r.text for r in line_dedup.dedup(documents(spark, texts)).collect()} == want


def test_query_and_stage_drop_recurring_lines_of_one_and_two_tokens(spark, tmp_path):
    from llm_fixtures import sf_dir
    from tagloom.llm import stages
    texts = ["Read more\nfirst text of its own", "Read more\nMenu\n\nthe second text is other", "Menu\n\nRead more.\nRead 2\nRead 3", "Read 4\n \nRead more"]
    docs = documents(spark, texts)
    want = {0: texts[0], 1: "Menu\n\nthe second text is other", 2: "\nRead more.\nRead 2\nRead 3", 3: "Read 4\n "}
    assert {r.doc_id: r.text for r in stages.lines(spark, docs, "").collect()} == want
    rows = queries.op6_line_dedup(spark, sf_dir(spark, tmp_path, documents=docs)).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_candidates_are_few_however_many_leaves_recur(spark, monkeypatch):
    once = ["\n".join(f"once{i} x{j} y z" for j in range(20)) for i in range(20)]
    twice = ["\n".join(f"twice{j} x{i} y z" for i in range(50)) for j in range(2)] * 2
    docs = documents(spark, once + twice)
    monkeypatch.setattr(line_dedup, "BITMAP_BITS", 6)
    for most in (28, 6):                                          # a larger bitmap, or a join
        monkeypatch.setattr(line_dedup, "MAX_BITMAP_BITS", most, raising=False)
        got = line_dedup.recurring_leaves(docs, 2)
        lines = line_dedup.candidate_lines(docs, *(got if isinstance(got, tuple) else (got,)))
        assert 200 <= lines.count() < 300                         # of 600; 200 of them recur


def test_rules_with_many_stray_languages(spark):
    """A stratum too small for any certificate changes nothing but the number of strata."""
    n = quality_rules.enough(3, 0.04, 0.05)
    cuts = [(r, i) for r, (_, _, c) in quality_rules.RULES.items() for i in range(len(c))]
    full = {"good": n + 50, "bad": 400} | {c: (0, 300) for c in cuts}
    small = {"good": n - 1, "bad": 400} | {c: (0, 300) for c in cuts}
    assert quality_rules.choose({"en": full, "x": small, "y": small}, 0.04, 0.05) == \
        quality_rules.choose({"en": full}, 0.04, 0.05, strata=3) | {"x": {}, "y": {}}
    text = " ".join(f"word{i}" for i in range(30))
    docs = documents(spark, [text] * 300, langs=[f"lang{i}" for i in range(300)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], LABELS)
    judged, v = quality_rules.judge(docs, labels)
    assert judged.where(F.col(f"{v}.kept")).count() == 300


def test_decontamination_block_after_block(spark, monkeypatch):
    """Many blocks, one pass each: the same hits, items, spans and texts as one block."""
    rng = random.Random(21)
    vocab = ["aa", "b", "c", "é", "1x", "dd"]
    items = [(i % 25, rng_text(rng, vocab, rng.choice([3, 13, 20, 40]))) for i in range(40)] + [(None, "b c"), (3, None), (4, "")]
    texts = EDGE + [rng_text(rng, vocab + ["zz"] * 4, n) for n in (1, 12, 40, 300) for _ in range(6)]
    texts += [items[0][1] + " " + items[1][1], items[2][1] + "  \n" + items[3][1] + " zz"]
    docs = documents(spark, texts).withColumn("leak_row", F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = []
    for size in (16 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found, leak = decontaminate.find(docs, bench, cut=True)
        assert found.columns == [*docs.columns, leak]
        out.append({r.doc_id: (r.text, r[leak]["n_words"], r[leak]["n_hit"], r[leak]["items"], r[leak]["spans"], r[leak]["rest"]) for r in found.collect()})
        kept = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
        out.append(kept)
    assert out[0] == out[2] and out[1] == out[3] and sum(v[2] > 0 for v in out[0].values()) > 10
