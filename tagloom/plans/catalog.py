"""Registered query plans: name -> (spark, sf_dir) -> DataFrame.

Each plan reads the driver tables (or what Spark derives from them) over whole tables.
Array results are rendered with ``array_join`` so both engines compare strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import bio, kernels
from tagloom.session import materialize, remove_at_exit, scratch_path
from tagloom.sources import annotated as an
from tagloom.sources import driver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", bio.bio_split("BIO_anno"))


# ---------------------------------------------------------------------------------
# 2.1 scans
# ---------------------------------------------------------------------------------
@query("scan_reviews")
def scan_reviews(spark, sf_dir):
    return driver.reviews(spark, sf_dir).select("id", "text", "BIO_anno", "class")


def _damaged(reviews):
    """Stand-in files: some records have a class that is no number, none at all, or a label too few."""
    names = F.split("BIO_anno", " ")
    short = F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), " ")
    i = F.col("id")
    return reviews.select("id", "text", F.when(i % 11 == 0, short).otherwise(F.col("BIO_anno")).alias("BIO_anno"),
                          F.when(i % 17 == 0, F.lit("x")).when(i % 13 == 0, F.lit(None)).otherwise(F.col("class").cast("string")).alias("class"))


@query("scan_annotated")
def scan_annotated(spark, sf_dir):
    """Annotated CSV files, sound rows and rejects."""
    path = scratch_path(spark, "annotated-csv")
    an.write(_damaged(driver.reviews(spark, sf_dir)), path)
    remove_at_exit(spark, path)
    good, rejects = an.load(spark, path)
    none = F.lit(None).cast("string")
    return good.withColumn("problem", none).unionByName(rejects.select(
        "id", none.alias("text"), none.alias("BIO_anno"), F.lit(None).cast("int").alias("class"), "problem"))


@query("scan_test")
def scan_test(spark, sf_dir):
    return driver.test_reviews(spark, sf_dir)


# ---------------------------------------------------------------------------------
# 2.2 projections
# ---------------------------------------------------------------------------------
@query("bio_split")
def bio_split(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    return r.select("id", F.size("labels").alias("n_labels"),
                    F.array_join("labels", ",").alias("labels"))


@query("label_encode")
def label_encode(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    return r.select("id", F.array_join(bio.label_encode("labels"), ",").alias("label_ids"))


@query("label_decode")
def label_decode(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    ids = bio.label_encode("labels")
    inner_ids = bio.label_encode(F.transform(bio.label_decode(ids), bio.bio_inner))
    return r.select("id", F.array_join(bio.label_decode(inner_ids), " ").alias("inner_labels"))


# ---------------------------------------------------------------------------------
# 2.8 text / array functions
# ---------------------------------------------------------------------------------
@query("char_labels")
def char_labels(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    z = bio.char_labels(F.col("text"), F.col("labels"))
    return r.select("id", F.size(z).alias("n_pairs"),
                    F.array_join(F.transform(z, lambda p: F.concat(p["ch"], F.lit("/"), p["label"])),
                                 "|").alias("pairs"))


@query("bio_spans")
def bio_spans(spark, sf_dir):
    r = bio.with_spans(_labels(driver.reviews(spark, sf_dir)), "labels", "spans")
    s = bio.explode_rows(r, "spans", "s", ["id", "text"])
    return s.select("id", F.col("s.start").cast("long").alias("start"),
                    F.col("s.end").cast("long").alias("end"), F.col("s.kind").alias("kind"),
                    F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
                    .alias("surface"))


# ---------------------------------------------------------------------------------
# tokenizer-based sequence work
# ---------------------------------------------------------------------------------
from tagloom.operators import tokenize as tk  # noqa: E402


def _null_join(arr, sep=" "):
    return F.array_join(arr, sep, "∅")


def _shown(column):
    """The joined form of a label column, made in the block: one string a text leaves it instead of one a character."""
    return tk.RowColumn("shown", "string", (column,), kernels.shown)


def train_reviews(spark, sf_dir):
    """The train part of the training corpus: what the vocabulary and the models learn from."""
    return sp.split_90_10(driver.reviews(spark, sf_dir)).where("split = 'train'")


def vocabulary(spark, sf_dir):
    """The tokenizer vocabulary, mined from the train part and written once per plan."""
    return materialize(tk.vocabulary(spark, train_reviews(spark, sf_dir)), "vocab", bounded=True)


LABELS = tk.RowColumn("labels", "array<string>", ("BIO_anno",), kernels.split_labels)
TOKEN_LABELS = tk.RowColumn("token_labels", "array<string>", ("text", "labels", "tokens"), kernels.align)
EXPANDED = tk.RowColumn("exp", "array<string>", ("tokens", "token_labels"), kernels.expand)
LABEL_IDS = tk.RowColumn("ids", "array<int>", ("token_labels",), kernels.label_ids)
REALIGNED = tk.RowColumn("realigned", "array<string>", ("text", "tokens", "exp"), kernels.realign)


def tokenized_reviews(spark, sf_dir, vocab=None, then=(), keep=("id", "text", "class", "tokens", "token_labels")):
    """Training corpus with labels, tokens, token labels (T03 + T04) and ``then``, block by block."""
    return tk.tokenize(driver.reviews(spark, sf_dir).select("id", "text", "BIO_anno", "class"), vocab if vocab is not None else vocabulary(spark, sf_dir),
                       then=[LABELS, TOKEN_LABELS, *then], keep=list(keep))


def label_windows(spark, sf_dir):
    """Token-label ids of the training corpus, one row per 198-token window."""
    t = tokenized_reviews(spark, sf_dir, then=[LABEL_IDS], keep=["id", "ids"])
    return tk.encode_windows(t, ["ids"])


@query("vocab_mining")
def vocab_mining(spark, sf_dir):
    return tk.mined_words(driver.reviews(spark, sf_dir))


@query("vocab_list")
def vocab_list(spark, sf_dir):
    return tk.vocabulary(spark, train_reviews(spark, sf_dir))


@query("vocab_trace")
def vocab_trace(spark, sf_dir):
    return tk.latin_run_trace(driver.reviews(spark, sf_dir))


@query("tokenize_corpus")
def tokenize_corpus(spark, sf_dir):
    t = tk.tokenize(driver.documents(spark, sf_dir), vocabulary(spark, sf_dir), more=[tk.id_column()], keep=["id", "tokens", "ids"])
    w = tk.encode_windows(t, ["tokens", "ids"])
    ids, mask, _types = tk.encode(F.col("win_ids"))
    return w.select("id", "win", F.size("win_tokens").alias("n_tokens"),
                    F.array_join("win_tokens", " ").alias("tokens"),
                    F.array_join(ids, ",").alias("input_ids"),
                    F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_attended"))


@query("strip_blank_labels")
def strip_blank_labels(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    return r.select("id", _null_join(bio.strip_blank_labels(F.col("text"), F.col("labels")))
                    .alias("labels_nb"))


@query("mark_text")
def mark_text(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    return r.select("id", bio.mark_text(F.col("text"), F.col("labels")).alias("marked"))


@query("bio_inner")
def bio_inner(spark, sf_dir):
    r = _labels(driver.reviews(spark, sf_dir))
    return r.select("id", F.array_join(F.transform("labels", bio.bio_inner), " ").alias("inner_labels"))


@query("align_labels")
def align_labels(spark, sf_dir):
    t = tokenized_reviews(spark, sf_dir, then=[_shown("token_labels")], keep=["id", "tokens", "shown"])
    return t.select("id", F.size("tokens").alias("n_tokens"), F.col("shown").alias("token_labels"))


@query("expand_labels")
def expand_labels(spark, sf_dir):
    t = tokenized_reviews(spark, sf_dir, then=[EXPANDED, _shown("exp")], keep=["id", "shown"])
    return t.select("id", F.col("shown").alias("char_labels"))


@query("realign_labels")
def realign_labels(spark, sf_dir):
    t = tokenized_reviews(spark, sf_dir, then=[EXPANDED, REALIGNED, _shown("realigned")], keep=["id", "shown"])
    return t.select("id", F.col("shown").alias("realigned"))


@query("frame_pad")
def frame_pad(spark, sf_dir):
    w = label_windows(spark, sf_dir)
    return w.select("id", "win", F.array_join(bio.frame_pad(F.col("win_ids")), ",").alias("label_ids"))


@query("mask_positions")
def mask_positions(spark, sf_dir):
    w = label_windows(spark, sf_dir)
    valid = bio.mask_positions(bio.frame_pad(F.col("win_ids")), tk.attention_mask(F.size("win_ids")))
    return w.select("id", "win", F.size(valid).alias("n_valid"), F.array_join(valid, ",").alias("valid_ids"))


@query("strip_frame")
def strip_frame(spark, sf_dir):
    w = label_windows(spark, sf_dir)
    return w.select("id", "win", F.array_join(bio.strip_frame(bio.frame_pad(F.col("win_ids"))), ",")
                    .alias("label_ids"))


@query("normalise_text")
def normalise_text(spark, sf_dir):
    t = tk.tokenize(driver.documents(spark, sf_dir), vocabulary(spark, sf_dir), keep=["id", "tokens"])
    detok = F.replace(F.array_join("tokens", " "), F.lit(" ##"), F.lit(""))
    return t.select("id", bio.normalise_text(detok).alias("normalised"))


# ---------------------------------------------------------------------------------
# corpus assembly, sampling, metrics
# ---------------------------------------------------------------------------------
from tagloom.operators import corpus as cp  # noqa: E402
from tagloom.operators import metrics as mt  # noqa: E402
from tagloom.operators import sampling as sp  # noqa: E402

SAMPLE_N = 50
HEAD_N = 40


@query("scan_aux")
def scan_aux(spark, sf_dir):
    parts = [cp.gpt_rows(spark, sf_dir).withColumn("type", F.lit("gpt")),
             cp.harmonise_ext(cp.ext_raw(spark, sf_dir)).withColumn("type", F.lit("ext")),
             cp.trans_rows(spark, sf_dir).drop("oid").withColumn("type", F.lit("trans"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("type", "text", "class")


@query("filter_category")
def filter_category(spark, sf_dir):
    return cp.filter_category(cp.ext_raw(spark, sf_dir))


@query("harmonise_columns")
def harmonise_columns(spark, sf_dir):
    return cp.harmonise_ext(cp.filter_category(cp.ext_raw(spark, sf_dir)))


def _full_corpus(spark, sf_dir):
    return cp.mood_corpus(spark, sf_dir, with_origin=True, with_gpt=True, from_retrans=True, with_ext=True)


@query("corpus_union")
def corpus_union(spark, sf_dir):
    return _full_corpus(spark, sf_dir).select("id", "oid", "text", "class", "type")


@query("corpus_no_origin")
def corpus_no_origin(spark, sf_dir):
    """G04 with the origin rows switched off: the schema-only seed (S03) opens the union."""
    return cp.mood_corpus(spark, sf_dir, with_origin=False, with_gpt=True, with_ext=True).select("id", "text", "class", "type")


@query("corpus_marked")
def corpus_marked(spark, sf_dir):
    """G04 with marked origin texts (T02) and generated rows."""
    return cp.mood_corpus(spark, sf_dir, with_gpt=True, mark=True).select("id", "text", "class", "type")


@query("class_strict")
def class_strict(spark, sf_dir):
    return _full_corpus(spark, sf_dir).groupBy("type", "class").agg(F.count(F.lit(1)).alias("n"))


@query("null_rows")
def null_rows(spark, sf_dir):
    return cp.null_rows(_full_corpus(spark, sf_dir).select("id", "oid", "class", "type"))


def _split_origin(spark, sf_dir):
    return sp.split_90_10(cp.origin_rows(spark, sf_dir))


def _train_plus_gpt(spark, sf_dir):
    s = _split_origin(spark, sf_dir)
    train = s.filter(F.col("split") == "train").drop("split").withColumn("type", F.lit("origin"))
    gpt = cp.gpt_rows(spark, sf_dir).withColumn("type", F.lit("gpt"))
    return train.unionByName(gpt, allowMissingColumns=True)


@query("split_90_10")
def split_90_10(spark, sf_dir):
    return _split_origin(spark, sf_dir).select("id", "split")


@query("split_then_augment")
def split_then_augment(spark, sf_dir):
    return _train_plus_gpt(spark, sf_dir).select("id", "class", "type")


@query("dataset_sizes")
def dataset_sizes(spark, sf_dir):
    train = cp.require_rows(_train_plus_gpt(spark, sf_dir), "train")
    val = _split_origin(spark, sf_dir).filter(F.col("split") == "val")
    return (train.select(F.lit("train").alias("split")).unionByName(val.select("split"))
            .groupBy("split").agg(F.count(F.lit(1)).alias("n")))


@query("debug_head")
def debug_head(spark, sf_dir):
    return sp.debug_head(driver.reviews(spark, sf_dir).select("id", "class"), HEAD_N)


@query("sample_n")
def sample_n(spark, sf_dir):
    return sp.sample_n(driver.reviews(spark, sf_dir).select("id", "class"), SAMPLE_N)


@query("sample_replace")
def sample_replace(spark, sf_dir):
    return sp.sample_with_replacement(driver.reviews(spark, sf_dir).select("id")).select("draw", "id")


@query("batching")
def batching(spark, sf_dir):
    return sp.batches(_split_origin(spark, sf_dir).select("id", "split")).select("id", "split", "batch_id")


@query("batching_in_place")
def batching_in_place(spark, sf_dir):
    """L05 where the rows lie: which rows share a batch follows their files, so the batches' sizes are returned."""
    b = sp.batches_in_place(_split_origin(spark, sf_dir).select("id", "split"))
    return b.groupBy("split", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("flatten_preds")
def flatten_preds(spark, sf_dir):
    t = tokenized_reviews(spark, sf_dir, keep=["id", "token_labels"]).select("id", bio.label_encode("token_labels").alias("ids"))
    b = sp.batches(sp.split_90_10(t)).select("split", "batch_id", F.struct("idx", "ids").alias("r"))
    # a batch is at most 40 texts
    g = b.groupBy("split", "batch_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    flat = F.flatten(F.transform("rows", lambda r: r["ids"]))
    return g.select("split", "batch_id", F.size(flat).alias("n_positions"), F.array_join(flat, ",").alias("flat"))


def _epochs(spark, sf_dir):
    return mt.epoch_rollup(mt.batch_metrics(mt.batch_items(spark, sf_dir)))


def _r8(c):
    return F.round(F.col(c), 8).alias(c)


@query("epoch_rollup")
def epoch_rollup(spark, sf_dir):
    return _epochs(spark, sf_dir).select("run", "epoch", _r8("loss"), _r8("acc"), _r8("val_acc"))


@query("best_epoch")
def best_epoch(spark, sf_dir):
    return mt.best_epochs(_epochs(spark, sf_dir)).select("run", "epoch", _r8("val_acc"), "is_best", "saved")


@query("epoch_log")
def epoch_log(spark, sf_dir):
    logs = mt.render_epoch_log(_epochs(spark, sf_dir))
    return mt.parse_epoch_records(logs, "record", ["run"]).select(
        "run", "epoch", _r8("loss"), _r8("acc"), _r8("val_acc"))


@query("epoch_log_batches")
def epoch_log_batches(spark, sf_dir):
    """Log files with batch lines, in the order of the file; the mean of an epoch's batches beside its record."""
    path = scratch_path(spark, "logs")
    mt.write_log(mt.batch_metrics(mt.batch_items(spark, sf_dir)), path)
    remove_at_exit(spark, path)
    log = mt.read_ordered_log(spark, path)
    run = F.regexp_extract("file", r"run=(\d+)", 1).cast("long").alias("run")
    mean = F.aggregate("batch_acc", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("batch_acc"), F.lit(0))
    return log.select(run, F.col("number").cast("long").alias("number"), "epoch", _r8("val_acc"), F.size("batch_acc").alias("n_batches"),
                      F.round(mean, 8).alias("batch_mean"), F.round(F.get("batch_acc", 0), 8).alias("first_acc"))


@query("argmax_class")
def argmax_class(spark, sf_dir):
    e = driver.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", mt.argmax("embedding").alias("argmax"))


# ---------------------------------------------------------------------------------
# count models: transitions, audit, fit, decode, path score, mood model, submission
# ---------------------------------------------------------------------------------
from tagloom.operators import models as md  # noqa: E402
from tagloom.operators import scoring as sc  # noqa: E402


def _tagger(spark, sf_dir, vocab=None):
    """(tokenized training corpus with splits, transitions, emissions); each computed once."""
    t = tokenized_reviews(spark, sf_dir, vocab, keep=("id", "tokens", "token_labels"))
    t = materialize(sp.split_90_10(t), "labelled_tokens")
    train = t.filter(F.col("split") == "train")
    trans = materialize(md.fit_transitions(spark, train), "transitions")
    emis = materialize(md.fit_emissions(train), "emissions")
    return t, trans, emis


@query("bio_transitions")
def bio_transitions(spark, sf_dir):
    _t, trans, _e = _tagger(spark, sf_dir)
    return trans.select("from_label", "to_label", "allowed", "n", F.round("score", 6).alias("score"))


@query("tagger_fit")
def tagger_fit(spark, sf_dir):
    _t, _tr, emis = _tagger(spark, sf_dir)
    return emis.select("label", "token", "n", F.round("logp", 6).alias("logp"))


def _val(t):
    return t.filter(F.col("split") == "val")


def _argmax(spark, sf_dir):
    t, _tr, emis = _tagger(spark, sf_dir)
    tagged = md.argmax_tags(_val(t).select("id", "tokens"), emis)
    return tagged.select("id", bio.label_decode("path").alias("token_labels"))


@query("tagger_argmax")
def tagger_argmax(spark, sf_dir):
    return _argmax(spark, sf_dir).select("id", F.array_join("token_labels", " ").alias("pred"))


@query("bio_audit")
def bio_audit(spark, sf_dir):
    """M02 on the unconstrained tagger's output, whole texts."""
    rows = materialize(_argmax(spark, sf_dir), "argmax_tags")
    pairs = md.framed_bigrams(rows, keep=("id",))
    return pairs.filter(~md.allowed(F.col("from_label"), F.col("to_label")))


@query("tagger_decode")
def tagger_decode(spark, sf_dir):
    t, trans, emis = _tagger(spark, sf_dir)
    d = md.decode(_val(t).select("id", "tokens"), trans, emis)
    return d.select("id", F.array_join(bio.label_decode("path"), " ").alias("pred"))


@query("path_nll")
def path_nll(spark, sf_dir):
    t, trans, emis = _tagger(spark, sf_dir)
    gold = _val(t).select("id", "tokens", bio.label_encode("token_labels").alias("gold"))
    return md.path_scores(gold, trans, emis, "gold").select("id", (-F.col("score") / md.MICRO).alias("nll"))


@query("token_accuracy")
def token_accuracy(spark, sf_dir):
    t, trans, emis = _tagger(spark, sf_dir)
    gold = _val(t).select("id", "tokens", bio.label_encode("token_labels").alias("gold"))
    d = md.decode(gold, trans, emis)
    # framed comparison: [SOS] and [EOS] always agree, [PAD] does not count
    hits = F.size(F.filter(F.zip_with("gold", "path", lambda g, p: g == p), lambda x: x)) + 2
    per_doc = d.select("id", hits.alias("hits"), (F.size("gold") + 2).alias("n"), F.lit("val").alias("split"))
    b = sp.batches(per_doc)
    return b.groupBy("batch_id").agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("acc"))


def _mood_train(spark, sf_dir, mark=False):
    """L06 for M06: the train part of the origin rows plus all generated rows."""
    origin = sp.split_90_10(cp.origin_rows(spark, sf_dir, mark)).where("split = 'train'").select("text", "class")
    return cp.strict_class(origin.unionByName(cp.gpt_rows(spark, sf_dir)))


def _mood(spark, sf_dir, vocab, mark=False):
    train = materialize(tk.tokenize(_mood_train(spark, sf_dir, mark), vocab, keep=["class", "tokens"]), "mood_tokens")
    model, priors = md.fit_mood(train)
    return materialize(model, "mood_model"), materialize(priors, "mood_priors")


@query("mood_fit")
def mood_fit(spark, sf_dir):
    model, _p = _mood(spark, sf_dir, vocabulary(spark, sf_dir))
    return model.select("class", "token", "n", F.round("logp", 6).alias("logp"))


@query("mood_predict")
def mood_predict(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir)
    return sc.mood(driver.test_reviews(spark, sf_dir), vocab, *_mood(spark, sf_dir, vocab), keep=["id", "class"])


@query("class_accuracy")
def class_accuracy(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir)
    val = sp.split_90_10(cp.origin_rows(spark, sf_dir)).where("split = 'val'")
    pred = sc.mood(val, vocab, *_mood(spark, sf_dir, vocab), out="pred", keep=["id", "class", "split", "pred"])
    b = sp.batches(materialize(pred.select("id", "class", "split", "pred"), "mood_pred"))
    return b.groupBy("batch_id").agg(F.round(F.avg((F.col("pred") == F.col("class")).cast("double")), 6)
                                     .alias("acc"))


def tag_docs(spark, sf_dir, docs, vocab, keep=("id",)):
    """M08 with a tagger fitted on the training corpus."""
    _t, trans, emis = _tagger(spark, sf_dir, vocab)
    return sc.tag(docs, vocab, trans, emis, keep=keep)


@query("tag_corpus")
def tag_corpus(spark, sf_dir):
    return tag_docs(spark, sf_dir, driver.test_reviews(spark, sf_dir), vocabulary(spark, sf_dir)).select("id", "BIO_anno")


@query("submission")
def submission(spark, sf_dir):
    """Tags and moods of the same row; the test texts are tokenized once for both."""
    return sc.score(driver.test_reviews(spark, sf_dir), fitted(spark, sf_dir))


def fitted(spark, sf_dir):
    """The tables that scoring needs, fitted on the training corpus and written once."""
    vocab = vocabulary(spark, sf_dir)
    _t, trans, emis = _tagger(spark, sf_dir, vocab)
    return sc.Models(vocab, trans, emis, *_mood(spark, sf_dir, vocab))


@query("stream_submission")
def stream_submission(spark, sf_dir):
    """M08 and M07 on a stream: the files of ``documents`` as they arrive, scored batch by batch."""
    def unlabelled(batch):
        known = driver.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
        return batch.select(F.col("doc_id").alias("id"), "text").join(known, "id", "left_anti")

    docs = ig.arriving(spark, sf_dir, "documents")
    scored = ss.score_stream(docs, fitted(spark, sf_dir), prepare=unlabelled)
    return spark.read.schema(sc.SUBMISSION).parquet(scored).select("id", "BIO_anno", "class")


def write_submission(df: DataFrame, path: str) -> None:
    """(id, BIO_anno, class) as CSV with a header."""
    df.select("id", "BIO_anno", "class").write.mode("overwrite").option("header", True).csv(path)


@query("submission_csv")
def submission_csv(spark, sf_dir):
    """The submission written as CSV and read back."""
    path = scratch_path(spark, "submission")
    write_submission(submission(spark, sf_dir), path)
    return spark.read.schema("id long, BIO_anno string, class int").option("header", True).csv(path).fillna("", ["BIO_anno"])


@query("two_stage_submission")
def two_stage_submission(spark, sf_dir):
    """The mood is read from the text marked with the predicted tags."""
    vocab = vocabulary(spark, sf_dir)
    tags = materialize(tag_docs(spark, sf_dir, driver.test_reviews(spark, sf_dir), vocab, keep=("id", "text")), "tags")
    marked = tags.select("id", "BIO_anno", bio.mark_text(F.col("text"), bio.bio_split("BIO_anno")).alias("text"))
    return sc.mood(marked, vocab, *_mood(spark, sf_dir, vocab, mark=True), keep=["id", "BIO_anno", "class"])


FLAGSHIP = "submission"


# ---------------------------------------------------------------------------------
# augmentation and back-translation ingest
# ---------------------------------------------------------------------------------
from tagloom.operators import augment as ag  # noqa: E402
from tagloom.streaming import ingest as ig  # noqa: E402
from tagloom.streaming import score as ss  # noqa: E402


@query("lexicon_long")
def lexicon_long(spark, sf_dir):
    fixed = ag.lexicon_long(ag.lexicon_wide(spark))
    r = bio.with_spans(_labels(driver.reviews(spark, sf_dir)), "labels", "spans")
    s = bio.explode_rows(r, F.filter("spans", lambda x: x["kind"] == "BANK"), "s", ["text"])
    mined = s.select(F.lit("corpus").alias("kind"),
                     F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("alias")) \
        .distinct()
    return fixed.unionByName(mined)


@query("entity_replace")
def entity_replace(spark, sf_dir):
    r = ag.with_entity_replaced(_labels(driver.reviews(spark, sf_dir)))
    return r.select("id", F.col("new_text").alias("text"), bio.join_labels(F.col("new_labels")).alias("BIO_anno"))


@query("callback_replace")
def callback_replace(spark, sf_dir):
    """the caller's own replacement of each mention, here the mention in brackets with its number."""
    r = ag.with_entity_replaced(_labels(driver.reviews(spark, sf_dir)), choose=lambda mention, n: F.concat(
        F.lit("["), mention, F.lit("#"), n.cast("string"), F.lit("]")))
    return r.select("id", F.col("new_text").alias("text"), bio.join_labels(F.col("new_labels")).alias("BIO_anno"))


@query("lexicon_replace")
def lexicon_replace(spark, sf_dir):
    """G01 / J05 with a lexicon table: the customers' names as aliases, by customer number."""
    names = driver.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("alias"))
    r = ag.with_lexicon_replaced(_labels(driver.reviews(spark, sf_dir)), names, ["pos"])
    return r.select("id", F.col("new_text").alias("text"), bio.join_labels(F.col("new_labels")).alias("BIO_anno"))


@query("bracket_perturb")
def bracket_perturb(spark, sf_dir):
    r = ag.with_brackets(_labels(driver.reviews(spark, sf_dir)))
    return r.select("id", F.col("new_text").alias("text"), bio.join_labels(F.col("new_labels")).alias("BIO_anno"))


@query("augment_union")
def augment_union(spark, sf_dir):
    """Originals plus 2N resampled rows passed through entity replacement."""
    r = _labels(driver.reviews(spark, sf_dir))
    drawn = sp.sample_with_replacement(r.select("id", "text", "labels", "class"))
    rep = ag.with_entity_replaced(drawn).select(
        "id", "draw", F.col("new_text").alias("text"), F.col("new_labels").alias("labels"), "class")
    orig = r.select("id", F.lit(None).cast("long").alias("draw"), "text", "labels", "class")
    u = orig.unionByName(rep)
    return u.select("id", "draw", "class", "text", bio.join_labels(F.col("labels")).alias("BIO_anno"))


@query("request_table")
def request_table(spark, sf_dir):
    s = sp.sample_n(driver.reviews(spark, sf_dir).select("id", "text"), SAMPLE_N)
    return ig.request_table(s, repeat=2)


@query("response_split")
def response_split(spark, sf_dir):
    return ig.split_response(ig.responses_from_documents(driver.table(spark, sf_dir, "documents")))


@query("stream_ingest_responses")
def stream_ingest_responses(spark, sf_dir):
    return spark.read.parquet(ig.ingest_responses(spark, sf_dir))


@query("open_requests")
def open_requests(spark, sf_dir):
    """T15 after S08: of two requests for every review, those that the ingested answers leave open."""
    answers = spark.read.parquet(ig.ingest_answers(ig.answers_from_documents(ig.arriving(spark, sf_dir, "documents"))))
    asked = ig.request_table(driver.reviews(spark, sf_dir).select("id", "text"), repeat=2)
    return ig.open_requests(asked, answers).select("oid", "rep", "user")


@query("backtranslation_join")
def backtranslation_join(spark, sf_dir):
    retrans = ig.split_response(ig.responses_from_documents(driver.table(spark, sf_dir, "documents")))
    return ig.backtranslation_join(retrans, driver.reviews(spark, sf_dir))
