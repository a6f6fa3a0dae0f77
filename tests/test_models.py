"""Tagger constraints, Viterbi against a numpy brute force, naive Bayes sanity."""
import numpy as np
from pyspark.sql import functions as F

from tagloom.constants import ALL_LABELS, FORBIDDEN
from tagloom.operators import models as md


def test_transition_rule_counts(spark):
    pairs = md.transition_pairs(spark).withColumn("ok", md.allowed(F.col("from_label"), F.col("to_label")))
    rows = pairs.collect()
    assert len(rows) == 144
    assert sum(r["ok"] for r in rows) == 82


def numpy_viterbi(em, start, end, tr):
    T, L = em.shape
    s = start + em[0]
    bps = []
    for t in range(1, T):
        c = s[:, None] + tr
        bps.append(c.argmax(axis=0))
        s = c.max(axis=0) + em[t]
    path = [int((s + end).argmax())]
    for bp in reversed(bps):
        path.insert(0, int(bp[path[0]]))
    return path


def test_viterbi_matches_numpy():
    rng = np.random.default_rng(7)
    L = 9
    tr = rng.integers(-1000, 0, (L, L))
    tr[rng.random((L, L)) < 0.3] = FORBIDDEN * md.MICRO
    start, end = rng.integers(-1000, 0, L), rng.integers(-1000, 0, L)
    cases = [rng.integers(-3, 0, (n, L)) for n in (5, 1, 0, 2, 40, 198, 40, 777)]     # ties are common
    got = md.viterbi(cases, start, tr, end)
    for g, c in zip(got, cases):
        assert g.tolist() == (numpy_viterbi(c, start, end, tr) if len(c) else [])
    assert [len(x) for x in md.viterbi([cases[2]], start, tr, end)] == [0]


def test_mention_across_an_old_window_edge(spark):
    """Whole texts have one frame: a mention over position 198 is one mention."""
    from tagloom.functions import bio
    train = [(i, ["x"] * 197 + ["a", "b"] + ["x"] * 50, ["O"] * 197 + ["B-BANK", "I-BANK"] + ["O"] * 50) for i in range(3)]
    rows = spark.createDataFrame(train, "id long, tokens array<string>, token_labels array<string>")
    trans, emis = md.fit_transitions(spark, rows), md.fit_emissions(rows)
    n = {(r["from_label"], r["to_label"]): r["n"] for r in trans.collect()}
    assert n["[SOS]", "O"] == 3 and n["B-BANK", "I-BANK"] == 3 and n["O", "[EOS]"] == 3
    got = md.decode(rows, trans, emis).select(bio.label_decode("path")).first()[0]
    assert got == train[0][2]
    assert not md.framed_bigrams(rows).filter(~md.allowed(F.col("from_label"), F.col("to_label"))).count()


def test_unseen_label_counts_zero(spark):
    rows = spark.createDataFrame([(["a", "b"], ["O", "O"])], "tokens array<string>, token_labels array<string>")
    _vec, unseen = md.emission_vectors(md.fit_emissions(rows))
    assert unseen.tolist() == [round(np.log(1 / 2) * md.MICRO)] * 8 + [round(np.log(1 / 4) * md.MICRO)]


def test_decode_is_legal(spark):
    import __spark_entry__ as E
    from tagloom.constants import ENTITY_LABELS
    d = E.queries()["tagger_decode"](spark, "/root/testdata/sf0.001").collect()
    assert d
    for r in d:
        labs = ["[SOS]"] + r["pred"].split() + ["[EOS]"]
        for a, b in zip(labs, labs[1:]):
            ok = b in ("O", "[EOS]") or b.startswith("B-") or b == ("I" + a[1:] if a.startswith("B") else a)
            assert ok, (a, b)
        assert set(r["pred"].split()) <= set(ENTITY_LABELS)
    assert ALL_LABELS[9] == "[SOS]"


def test_mood_predict_covers_test_set(spark):
    import __spark_entry__ as E
    from tagloom.sources import driver
    pred = E.queries()["mood_predict"](spark, "/root/testdata/sf0.001")
    test = driver.test_reviews(spark, "/root/testdata/sf0.001")
    assert pred.count() == test.count()
    assert {r["class"] for r in pred.collect()} <= {0, 1, 2}


def test_corpus_has_pieces_and_inner_labels(spark):
    from tagloom.plans import catalog
    t = catalog.tokenized_reviews(spark, "/root/testdata/sf0.001")
    tokens = t.select(F.explode(F.arrays_zip("tokens", "token_labels")).alias("x")).select("x.tokens", "x.token_labels")
    assert tokens.filter(F.col("tokens").startswith("##")).count() > 100
    assert tokens.filter(F.col("token_labels").startswith("I-")).count() > 100


def test_tokenize_without_usable_ids(spark):
    from tagloom.operators import tokenize as tk
    rows = [(1, "ab cd 12\tx"), (1, "zz ab"), (2, ""), (None, "cd"), (None, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = spark.createDataFrame([("ab",), ("cd",)], "word string")
    got = sorted(((r["id"], r["text"], r["tokens"]) for r in tk.tokenize(df, vocab).collect()), key=str)
    want = {"ab cd 12\tx": ["ab", "cd", "12", "[UNK]", "x"], "zz ab": ["z", "##z", "ab"], "": [], "cd": ["cd"], None: None}
    assert got == sorted(((i, t, want[t]) for i, t in rows), key=str)


def test_token_ids_name_one_token(spark):
    from tagloom.operators import tokenize as tk
    words = [f"w{a}" for a in ["ord", "all", "est", "ind"]] + [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]
    df = spark.createDataFrame([(i, [w, "##" + w[1:], "[UNK]", w[0]]) for i, w in enumerate(words)], "id long, tokens array<string>")
    pairs = {(t, x) for r in tk.token_ids(df).collect() for t, x in zip(r["tokens"], r["ids"])}
    assert len(pairs) == len({t for t, _ in pairs}) == len({x for _, x in pairs})


def test_one_decode_and_one_test_tokenization_per_submission(spark):
    import __spark_entry__ as E
    plan = E.queries()["submission"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") < 12 and "documents" not in plan


def test_line_list_and_vocabulary_trace(spark, tmp_path):
    from tagloom.constants import added_vocab
    from tagloom.operators import tokenize as tk
    (tmp_path / "words.txt").write_text("\n".join(added_vocab()) + "\n\n")
    assert {r["word"] for r in tk.read_line_list(spark, str(tmp_path / "words.txt")).collect()} == set(added_vocab())
    rows = [(1, "用visa卡", "O B-PRODUCT I-PRODUCT I-PRODUCT I-PRODUCT O"), (2, "真nb", "B-COMMENTS_ADJ I-COMMENTS_ADJ I-COMMENTS_ADJ"),
            (3, "line friends卡", "B-PRODUCT " + "I-PRODUCT " * 11 + "O")]
    got = {r["id"]: (r["run"], r["labels"]) for r in tk.latin_run_trace(spark.createDataFrame(rows, "id long, text string, BIO_anno string")).collect()}
    assert got == {1: ("visa", "B-PRODUCT I-PRODUCT I-PRODUCT I-PRODUCT"), 2: ("nb", "I-COMMENTS_ADJ I-COMMENTS_ADJ"),
                   3: ("line friends", "B-PRODUCT " + " ".join(["I-PRODUCT"] * 11))}


def _small_models(spark):
    from tagloom.operators import tokenize as tk
    vocab = spark.createDataFrame([("visa",), ("card",), ("good",)], "word string")
    train = [(["visa", "card", "i", "##s", "good"], ["B-BANK", "I-BANK", "O", "O", "B-COMMENTS_ADJ"], 1),
             (["card", "b", "##ad", "[UNK]"], ["B-PRODUCT", "O", "O", "O"], 0)]
    rows = spark.createDataFrame(train, "tokens array<string>, token_labels array<string>, class int")
    return tk, vocab, md.fit_transitions(spark, rows), md.fit_emissions(rows), *md.fit_mood(rows)


def test_columns_made_while_tokenizing_equal_the_lookups(spark):
    """Blocks of one row, of some rows and of all give what the row-wise lookups give."""
    tk, vocab, trans, emis, mood, priors = _small_models(spark)
    texts = ["visa card is good", "card bad\tgood", "", "   ", "99 visa, 卡 visa", "zz " * 300 + "visa", None, "visa card is good"]
    docs = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(texts)], "id long, text string")
    plain = tk.tokenize(docs.where("text is not null"), vocab)
    want = md.predict_mood(md.decode(plain, trans, emis), mood, priors, out="class")
    want = sorted(((r["id"], r["text"], r["tokens"], r["path"], r["class"]) for r in want.collect()), key=str)
    for size in (1, 400, 1 << 20):
        made = tk.tokenize(docs, vocab, more=[md.path_column(trans, emis), md.mood_column(mood, priors)], block_bytes=size)
        got = [(r["id"], r["text"], r["tokens"], r["path"], r["class"]) for r in made.collect()]
        assert sorted((r for r in got if r[1] is not None), key=str) == want
        assert [r[2:] for r in got if r[1] is None] == [(None, None, None)]


def test_blocks_hold_a_bounded_size_of_text(spark):
    from tagloom.operators import dictionary as dy
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(2000)], "id long, text string").repartition(3)
    sizes = dy.in_blocks(df, "text", 4096).groupBy(dy.BLOCK).agg(F.sum(F.length("text") + dy.ROW_BYTES).alias("n"), F.count("*").alias("k")).collect()
    assert sum(r["k"] for r in sizes) == 2000 and len(sizes) > 30
    assert max(r["n"] for r in sizes) < 4096 + 50 + dy.ROW_BYTES


def test_token_ids_made_while_tokenizing(spark):
    tk, vocab, *_rest = _small_models(spark)
    docs = spark.createDataFrame([(1, "visa 卡 good zz\t1"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: (r["tokens"], r["ids"]) for r in tk.tokenize(docs, vocab, more=[tk.id_column()]).collect()}
    assert got[2] == (None, None) and got[3] == ([], [])
    ids = dict(zip(*got[1]))
    assert ids["卡"] == 1000 + ord("卡") and ids["[UNK]"] == tk.UNK_TOKEN_ID and ids["z"] == 1000 + ord("z")
    assert sorted(ids[t] for t in ("visa", "good", "##z")) == [tk.FIRST_LONG_ID + i for i in range(3)]
    assert tk.tokenize(docs.limit(0), vocab, more=[tk.id_column()]).count() == 0


def test_scoring_shuffles_the_texts_once(spark):
    from tagloom.operators import scoring as sc
    _tk, vocab, trans, emis, mood, priors = _small_models(spark)
    docs = spark.createDataFrame([(1, "visa card")], "id long, text string")
    plan = sc.score(docs, sc.Models(vocab, trans, emis, mood, priors))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(__block") == 2           # the texts, and the entries of their pieces
    assert "text#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_block_work_is_in_one_python_pass(spark):
    """Scoring and token labels make no sequences of characters that leave the block: one Python step a task."""
    from tagloom.operators import models as md
    from tagloom.operators import scoring as sc
    tk, vocab, trans, emis, mood, priors = _small_models(spark)
    docs = spark.createDataFrame([(1, "visa good"), (None, None), (1, "")], "id long, text string")
    tags = sc.score(docs, sc.Models(vocab, trans, emis, mood, priors))
    rows = tk.tokenize(docs, vocab)
    for df in (tags, md.decode(rows, trans, emis), md.argmax_tags(rows, emis)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1 and "EvalPython" not in plan


def test_trace_of_long_batches_is_made_in_slices(spark):
    from tagloom.operators import tokenize as tk
    n = 300
    rows = [(i, "ab 1 " * 2000, " ".join(["O"] * 10000)) for i in range(n)] + [(None, None, None), (n, "", "")]
    df = spark.createDataFrame(rows, "id long, text string, BIO_anno string").coalesce(1)
    made = tk.latin_run_trace(df)
    assert "EvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == n * 2000 and made.where("run = 'ab' and labels = 'O O'").count() == n * 2000
    assert made.where("id = 7").selectExpr("min(k)", "max(k)", "count(distinct k)").first()[:] == (0, 1999, 2000)


def test_rows_with_tokens_in_blocks(spark):
    """Decode, argmax and path score of null, empty and repeated rows, and of tokens never seen."""
    from tagloom.operators import models as md
    _tk, _vocab, trans, emis, _mood, _priors = _small_models(spark)
    rows = spark.createDataFrame([(1, ["visa", "zz"], [8, 8]), (1, ["visa", "zz"], [8, 8]), (None, [], []), (2, None, None)],
                                 "id long, tokens array<string>, gold array<int>")
    sizes = {"decode": md.decode(rows, trans, emis), "argmax": md.argmax_tags(rows, emis)}
    for df in sizes.values():
        assert sorted(str((r["id"], r["path"] and len(r["path"]), r["path"] is None)) for r in df.collect()) == \
            sorted(map(str, [(1, 2, False), (1, 2, False), (None, [], False), (2, None, True)]))
    scores = sorted(str((r["id"], r["score"])) for r in md.path_scores(rows, trans, emis, "gold").collect())
    assert scores[0] == scores[1] and scores[2:] == ["(2, None)", "(None, 0)"]


def test_counts_of_a_slice_are_those_of_the_exploded_rows(spark):
    """missing labels, unequal lengths, null and empty texts; the rows are read once, not once a use."""
    rows = spark.createDataFrame([(["a", "b", "a"], ["B-BANK", "I-BANK", "O"]), (["a", "b"], ["O"]), (["a"], ["O", "O"]), (["c", None], [None, "O"]),
                                  (None, ["O"]), (["a"], None), ([], []), (["a", "a"], ["[PAD]", "O"])] * 3, "tokens array<string>, token_labels array<string>").coalesce(1)
    want = md.framed_bigrams(rows).groupBy("from_label", "to_label").count()
    assert sorted(map(str, map(tuple, md.bigram_counts(rows).collect()))) == sorted(map(str, map(tuple, want.collect())))
    each = rows.select(F.explode(F.arrays_zip("token_labels", "tokens")).alias("p")).select("p.token_labels", "p.tokens")
    want = each.where(F.col("token_labels").isin("O", "B-BANK", "I-BANK")).groupBy("token_labels", "tokens").count()
    assert sorted(map(str, map(tuple, md.token_label_counts(rows).collect()))) == sorted(map(str, map(tuple, want.collect())))
    for fitted in (md.fit_emissions(rows), md.fit_transitions(spark, rows)):
        assert "LogicalRDD" not in (plan := fitted._jdf.queryExecution().optimizedPlan().toString()) and "MapInArrow" not in plan


def test_batches_of_written_steps_are_bounded(spark):
    """What a Python step holds does not follow the rows of its task."""
    import pyarrow as pa

    from tagloom.session import BATCH, materialize

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = {k: spark.conf.get(k) for k in BATCH}
    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 6000, 10).otherwise(10000)).alias("t"))
    got = materialize(rows.mapInArrow(sizes, "n long, size long"), "sizes", bounded=True).agg(F.sum("n"), F.max("n"), F.max("size")).first()
    assert got[0] == 9000 and got[1] <= 2000 and got[2] < 6 << 20
    assert before == {k: spark.conf.get(k) for k in BATCH}


def test_decoder_holds_a_bounded_number_of_positions(monkeypatch):
    """a block is decoded group by group, with the paths of the texts one by one."""
    rng = np.random.default_rng(3)
    tr, start, end = rng.integers(-9, 0, (9, 9)), rng.integers(-9, 0, 9), rng.integers(-9, 0, 9)
    n = np.array([0, 70, 3, 200, 0, 50, 1, 64, 40])
    offsets, scores = np.concatenate([[0], np.cumsum(n)]), rng.integers(-5, 0, (n.sum(), 9))
    held, plain = [], md.viterbi

    def viterbi(mats, *model):
        held.append(sum(map(len, mats)) - max(map(len, mats), default=0))
        return plain(mats, *model)

    monkeypatch.setattr(md, "viterbi", viterbi)
    monkeypatch.setattr(md, "POSITIONS", 100)
    got = md.best_paths(scores, offsets, start, tr, end).to_pylist()
    assert got == [plain([scores[a:b]], start, tr, end)[0].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert max(held) <= 100 and len(held) > 2
    assert md.best_paths(scores[:0], np.zeros(1, np.int64), start, tr, end).to_pylist() == []


def test_sequences_leave_a_block_as_strings(spark):
    """no array of one string a character or token goes from the block to the query."""
    import __spark_entry__ as E
    for name, gone in (("expand_labels", "exp"), ("realign_labels", "realigned"), ("mask_positions", "token_labels")):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        made = [p for p in plan.toString().splitlines() if "FlatMapCoGroupsInArrow" in p]
        assert made and all(f"{gone}#" not in p.rsplit(", [", 1)[-1] for p in made)
