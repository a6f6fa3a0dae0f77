"""Literal fixtures for the sequence functions (FIXTURES X4)."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.constants import ALL_LABELS
from tagloom.functions import bio, kernels


def one(spark, row, schema, fn):
    df = spark.createDataFrame([row], schema)
    return fn(df).collect()[0][0]


def test_bio_inner(spark):
    got = one(spark, (["B-BANK", "I-BANK", "O", "[SOS]"],), "l array<string>",
              lambda d: d.select(F.transform("l", bio.bio_inner)))
    assert got == ["I-BANK", "I-BANK", "O", "[SOS]"]


def test_strip_blank_labels(spark):
    got = one(spark, ("工行 app", "B-BANK I-BANK O B-PRODUCT I-PRODUCT I-PRODUCT"), "t string, b string",
              lambda d: d.select(bio.strip_blank_labels(F.col("t"), bio.bio_split("b"))))
    assert got == ["B-BANK", "I-BANK", "B-PRODUCT", "I-PRODUCT", "I-PRODUCT"]


def test_align(spark):
    df = spark.createDataFrame([("工行 app好", "B-BANK I-BANK O B-PRODUCT I-PRODUCT I-PRODUCT O".split(), ["工", "行", "ap", "##p", "好"])],
                               "s string, l array<string>, t array<string>")
    got = bio.with_aligned(df, "s", "l", "t", "x").select("x").collect()[0][0]
    assert got == ["B-BANK", "I-BANK", "B-PRODUCT", "I-PRODUCT", "O"]


def _expand(spark, toks, labs):
    df = spark.createDataFrame([(toks, labs)], "t array<string>, l array<string>")
    return bio.with_expanded(df, "t", "l", "x").select("x").collect()[0][0]


def test_expand(spark):
    assert _expand(spark, ["工", "行", "app", "好"], ["B-BANK", "I-BANK", "B-PRODUCT", "O"]) == \
        ["B-BANK", "I-BANK", "B-PRODUCT", "I-PRODUCT", "I-PRODUCT", "O"]
    assert _expand(spark, ["ap", "##p"], ["B-PRODUCT", "O"]) == ["B-PRODUCT", "I-PRODUCT", "I-PRODUCT"]


def _realign(rows):
    text, tokens, labels = (pa.array([r[i] for r in rows]) for i in range(3))
    return kernels.by_slices(kernels.realign, text, tokens.cast(pa.list_(pa.string())), labels.cast(pa.list_(pa.string()))).to_pylist()


def test_realign_cases():
    exp = ["B-BANK", "I-BANK", "B-PRODUCT", "I-PRODUCT", "I-PRODUCT", "O"]
    assert _realign([
        ("工行 App好", ["工", "行", "app", "好"], exp),
        ("工行  ", ["工", "行"], ["B-BANK", "I-BANK"]),
        ("工㐀行", ["工", "[UNK]", "行"], ["B-BANK", "I-BANK", "I-BANK"]),
        ("a-b-c", ["a", "b", "c"], ["B-BANK", "I-BANK", "O"]),      # a tokenizer that drops characters: they get O
        (None, ["a"], ["O"]), ("", [], []), ("  ", ["a"], ["O"]), ("ab", ["ab"], ["B-BANK"]), ("a \t", ["a", "[UNK]"], ["B-BANK", "O"]),
    ]) == [["B-BANK", "I-BANK", "O", "B-PRODUCT", "I-PRODUCT", "I-PRODUCT", "O"], ["B-BANK", "I-BANK"], ["B-BANK", "O", "I-BANK"],
           ["B-BANK", "O", "I-BANK", "O", "O"], None, [], ["O", "O"], ["B-BANK", None], ["B-BANK", "O"]]


def test_kernels_match_per_element_definitions():
    """Each kernel against its definition, element by element, over rows that fall in several slices."""
    rng = random.Random(4)
    pool = ["B-BANK", "I-BANK", "B-PRODUCT", "I-PRODUCT", "O"]
    rows = []
    for _ in range(400):
        tokens = [rng.choice(["工", "a", "app", "[UNK]", "##p", "##ay", "好好", "B"]) for _ in range(rng.randint(0, 12))]
        body = [t if t != "[UNK]" else "\t" for t in tokens]
        text = "".join(rng.choice(["", " ", "", "  "]) + t.removeprefix("##").upper() for t in body) + rng.choice(["", " "])
        rows.append((text, tokens, [rng.choice(pool) for _ in range(rng.randint(0, len(text) + 2))], [rng.choice(pool) for _ in tokens]))
    rows[3], rows[7] = (None, ["a"], ["O"], ["O"]), ("a", None, ["O"], None)
    size = lambda t: 1 if t == "[UNK]" else len(t.removeprefix("##"))
    strings = pa.list_(pa.string())
    text, tokens, labels, token_labels = (pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.string(), strings, strings, strings]))
    kernels.SLICE, keep = 200, kernels.SLICE
    try:
        aligned = kernels.by_slices(kernels.align, text, labels, tokens).to_pylist()
        expanded = kernels.by_slices(kernels.expand, tokens, token_labels).to_pylist()
        found = kernels.by_slices(kernels.spans, labels).to_pylist()
        back = kernels.by_slices(kernels.realign, text, tokens, pa.array(expanded, strings)).to_pylist()
    finally:
        kernels.SLICE = keep
    for i, (t, toks, labs, tlabs) in enumerate(rows):
        want = [(m.start(), m.end(), m.group().split("-")[1][:4]) for m in re.finditer(r"B-BANK(?:,I-BANK)*(?=,|$)|B-PROD(?:,I-PROD)*(?=,|$)",
                                                                                     ",".join(labs).replace("PRODUCT", "PROD"))]
        joined = ",".join(labs).replace("PRODUCT", "PROD")
        want = [(joined[:s].count(","), joined[:e].count(",") + 1, k) for s, e, k in want]
        assert [(s["start"], s["end"], s["kind"][:4]) for s in found[i]] == want
        if t is None or toks is None:
            assert aligned[i] is None and back[i] is None
            continue
        solid = [lab for ch, lab in zip(t, labs) if ch != " "]
        starts = [sum(map(size, toks[:k])) for k in range(len(toks))]
        assert aligned[i] == [solid[s] if s < len(solid) else None for s in starts]
        want = []
        for k, tok in enumerate(toks):
            heads = [h for h in range(k + 1) if not toks[h].startswith("##")]
            lab = tlabs[heads[-1]] if heads else None
            inner = "I" + lab[1:] if lab and lab[0] == "B" else lab
            want += [inner] * size(tok) if tok.startswith("##") else [lab] + [inner] * (size(tok) - 1)
        assert expanded[i] == want
        chars = [c for tok in toks for c in ([None] if tok == "[UNK]" else tok.removeprefix("##").lower())]
        place = [p for p, ch in enumerate(t) if ch != " "]
        got = {p: "O" if c is None else want[k] for k, (p, c) in enumerate(zip(place, chars))}
        assert [got.get(p, "O") for p in range(len(back[i]))] == back[i] and len(back[i]) <= len(t)


def test_meet_skips_what_the_tokenizer_drops():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 5, 3000)
    text, want = [], []
    for k, b in enumerate(body):
        for _ in range(rng.integers(0, 400) if rng.random() < 0.02 else 0):
            text.append(9)
            want.append(-1)
        text.append(b)
        want.append(k)
    assert kernels.meet(np.array(text + [9, 9]), body).tolist() == want


def test_helpers_can_be_filtered_and_exploded(spark):
    text = "visa card of the bank " * 2000
    rows = spark.createDataFrame([(i, text, ["O"] * len(text), text.split()) for i in range(8)],
                                 "id long, s string, l array<string>, t array<string>")
    d = bio.with_aligned(rows, "s", "l", "t", "a")
    d = bio.with_realigned(bio.with_expanded(d, "t", "a", "e"), "s", "t", "e", "r")
    for c in ("a", "e", "r"):
        n = d.filter(F.size(c) > 0).select(F.explode(c).alias("x")).filter("x = 'O'").groupBy("x").count().first()["count"]
        assert n > 8 * 2000


def test_mark_text(spark):
    got = one(spark, ("工行好", "B-BANK I-BANK O"), "t string, b string",
              lambda d: d.select(bio.mark_text(F.col("t"), bio.bio_split("b"))))
    assert got == "B-BANK工I-BANK行好"


def test_frame_pad(spark):
    got = one(spark, ([0, 1],), "x array<int>", lambda d: d.select(bio.frame_pad(F.col("x"), 6)))
    assert got == [9, 0, 1, 10, 11, 11]
    got = one(spark, ([9, 0, 1, 10, 11, 11],), "x array<int>", lambda d: d.select(bio.strip_frame(F.col("x"))))
    assert got == [0, 1]


def _spans(spark, labels):
    df = spark.createDataFrame([(labels.split(),)], "l array<string>")
    return [(s["start"], s["end"], s["kind"]) for s in bio.with_spans(df, "l", "s").select("s").collect()[0][0]]


def test_spans(spark):
    assert _spans(spark, "B-BANK I-BANK O B-PRODUCT I-PRODUCT B-PRODUCT") == \
        [(0, 2, "BANK"), (3, 5, "PRODUCT"), (5, 6, "PRODUCT")]
    assert _spans(spark, "O I-BANK B-BANK") == [(2, 3, "BANK")]
    assert _spans(spark, "B-BANK I-PRODUCT I-BANK") == [(0, 1, "BANK")]


def test_exclusive_prefix(spark):
    got = one(spark, ([3, 0, 2, 1],), "x array<int>", lambda d: d.select(bio.exclusive_prefix(F.col("x"))))
    assert got == [0, 3, 3, 5]


def test_label_codec(spark):
    got = one(spark, (["B-BANK", "O", "[PAD]"],), "l array<string>",
              lambda d: d.select(bio.label_decode(bio.label_encode("l"))))
    assert got == ["B-BANK", "O", "[PAD]"]


def test_pieces_are_those_of_the_pattern():
    """pieces cut from the bytes, slices and nulls included."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab  Z09_\t\n\u00e9\u4e2d\U0001f600\u00a0\0"), n)) for n in rng.integers(0, 30, 300)] + [None, "", "  ", "a", "\u00e9"]
    find = re.compile(r"[A-Za-z]+|[0-9]+|[^ ]").findall
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(7, 60), pa.array(texts).slice(300), pa.array([], pa.string()), pa.array([None], pa.string())):
        found, at = kernels.pieces(column)
        got = [found[a:b].to_pylist() for a, b in zip(at[:-1], at[1:])]
        assert got == [find(t or "") for t in column.to_pylist()]


def test_label_ids_and_shown_labels():
    strings = pa.list_(pa.string())
    assert kernels.by_slices(kernels.label_ids, pa.array([["O", "B-BANK"], None, []], strings)).to_pylist() == [[ALL_LABELS.index("O"), ALL_LABELS.index("B-BANK")], None, []]
    for odd in (["O", "B-ODD"], ["O", None]):
        with pytest.raises(ValueError, match="unknown label"):
            kernels.by_slices(kernels.label_ids, pa.array([odd], strings))
    assert kernels.by_slices(kernels.shown, pa.array([["O", None, "I-BANK"], None, []], strings)).to_pylist() == ["O \u2205 I-BANK", None, ""]
