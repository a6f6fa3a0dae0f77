"""Streaming ingest is idempotent; the driver contract works; oracle agreement on sf0.001."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as E
from tagloom.session import scratch_path
from tagloom.operators import scoring as sc
from tagloom.plans import catalog
from tagloom.streaming import ingest as ig
from tagloom.streaming import score as ss

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHEAP = ["scan_reviews", "bio_split", "label_encode", "char_labels", "bio_spans", "mark_text", "align_labels",
         "expand_labels", "realign_labels", "tokenize_corpus", "vocab_list", "corpus_union", "split_90_10",
         "batching", "sample_replace", "epoch_rollup", "best_epoch", "epoch_log", "argmax_class",
         "entity_replace", "bracket_perturb", "response_split", "backtranslation_join", "tagger_decode", "path_nll",
         "token_accuracy", "class_accuracy", "bio_audit", "submission", "two_stage_submission", "augment_union", "vocab_trace",
         "stream_submission", "open_requests", "scan_annotated", "lexicon_replace", "epoch_log_batches"]


def test_stream_rerun_adds_nothing(spark):
    sink = scratch_path(spark, "test-retrans")
    p1 = ig.ingest_responses(spark, SF, sink)
    n1 = spark.read.parquet(p1).count()
    p2 = ig.ingest_responses(spark, SF, sink)
    assert spark.read.parquet(p2).count() == n1 > 0


def test_stream_ingest_of_a_folder_of_files(spark, tmp_path):
    """The table is a folder of part files, not one file."""
    rows = [(i, "en", "s", f"text {i}") for i in range(25)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = E.queries()["stream_ingest_responses"](spark, str(tmp_path)).collect()
    want = E.queries()["response_split"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 26


def _answers(spark, folder, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "oid long, rep int, content string").coalesce(1).write.mode("append").parquet(folder)
        os.utime(max(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime), (1e9 + i, 1e9 + i))
    return spark.readStream.schema("oid long, rep int, content string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_answers_are_kept_once_per_request(spark, tmp_path):
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(1, 1, "a#####b"), (1, 1, "a#####b"), (2, 1, "x"), (None, 1, "n#####n")]
    late = [(1, 1, "later#####answer"), (1, 2, "c#####d"), (2, 1, "y#####z"), (3, 1, None), (None, 1, "m#####m")]
    data = ig.ingest_answers(_answers(spark, folder, first, late), sink)
    want = [(None, 1, "n", "n"), (1, 1, "a", "b"), (1, 2, "c", "d"), (2, 1, '["x"]', "ERR"), (3, 1, None, "ERR")]
    got = sorted(map(tuple, spark.read.parquet(data).select("oid", "rep", "en", "cn").collect()), key=str)
    assert got == sorted(want, key=str)
    data = ig.ingest_answers(_answers(spark, folder), sink)          # nothing new: nothing added
    assert spark.read.parquet(data).count() == len(want)
    _answers(spark, folder, [(4, 1, "e#####f"), (1, 2, "again#####x")])
    ig.ingest_answers(_answers(spark, folder), sink)
    answers = spark.read.parquet(data)
    assert answers.count() == len(want) + 1
    asked = spark.createDataFrame([(i, r, "q") for i in range(1, 7) for r in (1, 2)], "oid long, rep int, user string")
    assert sorted(map(tuple, ig.open_requests(asked, answers).select("oid", "rep").collect())) == \
        [(2, 2), (3, 2), (4, 2), (5, 1), (5, 2), (6, 1), (6, 2)]
    again = ig.open_requests(asked, answers, ask_again=True).select("oid", "rep").collect()
    assert (2, 1) in map(tuple, again) and (3, 1) in map(tuple, again)


@pytest.mark.parametrize("order", [0, 1])
def test_stream_scoring_survives_a_failure(spark, tmp_path, order):
    """Files in either order; the run is ended in the middle of a batch, after part of it was written."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:60]
    rows = [(r.doc_id, r.text) for r in docs] + [(None, "Of the bank."), (7, None), (7, "")]
    parts = [rows[i::3] for i in range(3)][::-1 if order else 1]
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "id long, text string").coalesce(1).write.mode("append").parquet(folder)
        os.utime(max(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime), (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    models, fails = catalog.fitted(spark, SF), [True]

    def prepare(batch):
        if batch.count() and fails and spark.read.schema(sc.SUBMISSION).parquet(os.path.join(sink, "data")).count():
            fails.pop()
            batch.limit(1).selectExpr("id", "'' BIO_anno", "1 class").write.mode("overwrite").parquet(ss.batch_folder(sink, 1))
            raise RuntimeError("ended")
        return batch

    os.makedirs(os.path.join(sink, "data"))
    with pytest.raises(Exception, match="ended"):
        ss.score_stream(stream, models, sink, prepare)
    data = ss.score_stream(stream, models, sink)
    got = spark.read.schema(sc.SUBMISSION).parquet(data).select("id", "BIO_anno", "class").collect()
    want = sc.score(spark.createDataFrame(rows, "id long, text string"), models).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)
    ss.score_stream(stream, models, sink)
    assert spark.read.parquet(data).count() == len(rows)


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "BIO_anno", "class"]
    assert df.count() == 113


def test_every_query_of_the_library_has_an_oracle():
    from tagloom.plans import catalog
    assert set(catalog.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(str(fix(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_oracle_agreement(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)
