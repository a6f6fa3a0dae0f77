"""The pipeline's stages on a fixture where each has something to do."""
import random

import corpus_pipeline
from llm_fixtures import documents, sf_dir
from tagloom.llm import stages


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    syl = ["ba", "ke", "lo", "mu", "ti", "sa", "re", "no", "du", "fi"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(120) for _ in range(30)]
    item = text(20)
    texts = clean + [clean[0] + "\n", "too short", text(30) + " " + item, None, text(150) + "\nAll rights are reserved here.",
                     text(150) + "\nAll rights are reserved here."]
    docs = documents(spark, texts)
    d = sf_dir(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"),
               labels=spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stages.written(stage(spark, at, d), name)
        seen[name] = {r["doc_id"]: r.asDict() for r in at.collect()}
        if name != "mixing":
            assert at.columns == docs.columns
    ids = set(range(len(texts)))
    assert set(seen["quality_rules"]) == ids - {31, 33}
    assert set(seen["line_dedup"]) == ids - {31, 33}
    assert seen["line_dedup"][30]["text"] == "" and seen["line_dedup"][34]["text"] == texts[34]
    assert "reserved" not in seen["line_dedup"][35]["text"]
    assert set(range(30)) <= set(seen["simhash_near_dedup"])
    assert set(seen["benchmark_decontamination"]) == set(seen["simhash_near_dedup"]) - {32}
    assert set(seen["mixing"]) == set(seen["benchmark_decontamination"]) and all(r["rate"] >= 0 for r in seen["mixing"].values())
    for i, r in seen["mixing"].items():                    # the product: the text and columns that the stage before left
        assert {c: r[c] for c in docs.columns} == seen["benchmark_decontamination"][i]
        assert r["n_tokens"] == len((r["text"] or "").split()) and sum(r["p"]) > 0.99
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: r["text"] for i, r in seen["mixing"].items()}


CLASHES = ("n_tokens", "p", "rate", "mix_n", "mix_bucket", "mix_l0", "mix_at", "verdict", "line_report", "fp", "component_id", "leak",
           "row", "hits", "items", "leaf", "part", "kept", "spans", "found")


def test_pipeline_with_any_columns_and_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null, empty and long texts, and extra columns of the operators' names."""
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    texts = [text(80) for _ in range(12)] + [None, "", text(20_000), text(60), text(60)]
    ids = [*range(12), 12, 13, 14, None, 3]
    rows = [(i, t, "en", "s", len(t or ""), *CLASHES) for i, t in zip(ids, texts)]
    rows += [rows[0], (None, None, None, None, None, *CLASHES)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    d = sf_dir(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(None, None), (1, "")], "item_id long, text string"),
               labels=spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*docs.columns, "n_tokens_", "p_", "rate_"]
    got = out.collect()
    assert all(r[c] == c for r in got for c in CLASHES)
    assert {texts.index(r["text"]) for r in got} >= {1, 2, 4, 14, 15, 16}      # clean texts stay, whatever their ids


def test_pipeline_of_empty_tables(spark, tmp_path):
    d = sf_dir(spark, tmp_path, documents=documents(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"),
               labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = corpus_pipeline.run(spark, d)
    assert out.count() == 0 and set(documents(spark, []).columns) <= set(out.columns)
