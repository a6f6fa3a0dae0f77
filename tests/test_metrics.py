"""Epoch metrics: best-epoch flags on the 20-epoch log (X1), log parsing."""
import os
import random
import tempfile

from tagloom.operators import metrics as mt

X1 = [0.90447487, 0.93041338, 0.92343829, 0.93107322, 0.93931591, 0.93088596, 0.94036349, 0.93498960,
      0.94278987, 0.93771360, 0.93799901, 0.93783633, 0.93680100, 0.93461225, 0.93568199, 0.93822071,
      0.94085184, 0.93847886, 0.93855456, 0.93680829]


def test_best_epoch_flags(spark):
    df = spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(X1)], "run int, epoch int, val_acc double")
    rows = mt.best_epochs(df, freq=5).orderBy("epoch").collect()
    assert [r["epoch"] for r in rows if r["is_best"]] == [1, 2, 4, 5, 7, 9]
    assert [r["epoch"] for r in rows if r["saved"]] == [1, 2, 4, 5, 6, 7, 9, 11, 16]
    assert not any(r["saved"] for r in mt.best_epochs(df, freq=0).collect())


def test_best_epochs_over_many_ranges(spark):
    """Two runs, ranges of 7 epochs, nulls, ties: the same flags as one pass from the left."""
    rng = random.Random(3)
    rows = [(run, e, rng.choice([None, round(rng.random(), 2), round(rng.random() * e / 500, 3)])) for run in (1, None) for e in range(1, 400)]
    df = spark.createDataFrame(rows, "run int, epoch int, val_acc double").repartition(5)
    got = {(r["run"], r["epoch"]): (r["is_best"], r["saved"]) for r in mt.best_epochs(df, freq=5, size=7).collect()}
    best = {1: -1.0, None: -1.0}
    for run, e, v in rows:
        flag = v is not None and v > best[run]
        best[run] = v if flag else best[run]
        assert got[run, e] == (flag, flag or (e - 1) % 5 == 0)
    assert len(got) == len(rows)


LOG = """{"val acc 0.91"}
Epochs: 1 | 
                Loss:  0.12349840 | 
                Accuracy:  0.79876161 |
                val_Accuracy:  0.90447487 |
               
Epochs: 2 | 
                Loss:  nan | 
                Accuracy:  0.043944 |
               
"""


def test_read_epoch_log(spark):
    d = tempfile.mkdtemp(prefix="tagloom-log-")
    with open(os.path.join(d, "run.log"), "w") as f:
        f.write(LOG)
    rows = mt.read_epoch_log(spark, d).orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [1, 2]
    assert rows[0]["loss"] == 0.1234984 and rows[0]["val_acc"] == 0.90447487
    assert rows[1]["loss"] != rows[1]["loss"]          # NaN
    assert rows[1]["val_acc"] is None and rows[1]["acc"] == 0.043944


def test_render_then_parse_roundtrip(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 0.25, None), (0, 2, 0.1, 0.75, 0.9)],
                               "run int, epoch int, loss double, acc double, val_acc double")
    back = mt.parse_epoch_records(mt.render_epoch_log(df), "record", ["run"]).orderBy("epoch").collect()
    assert [(r["epoch"], r["loss"], r["acc"], r["val_acc"]) for r in back] == [(1, 0.5, 0.25, None), (2, 0.1, 0.75, 0.9)]


def test_batch_lines_belong_to_the_record_that_follows(spark, tmp_path):
    """Two files, a restarted run, an unfinished epoch; splits of 300 bytes give what one split gives."""
    rng = random.Random(5)

    def record(epoch, values):
        mean = sum(values) / len(values) if values else float("nan")
        return ("".join(f"  3%|x\rval acc {v!r}\n" for v in values)
                + f"Epochs: {epoch} | \n                Loss:  0.5 | \n                Accuracy:  0.25 |\n                val_Accuracy: {mean: .8f} |\n")

    want = []
    for name, epochs, rest in (("a", [*range(1, 30), 1, 2], [0.5, 0.25]), ("b", [1], []), ("c", [], [0.125])):
        text = "a line before all\n" if name == "a" else ""
        for n, e in enumerate(epochs, 1):
            values = [round(rng.random(), 6) for _ in range(18 if e % 4 else 0)]
            text += record(e, values)
            want.append((name, n, e, values))
        if rest:
            want.append((name, len(epochs) + 1, None, rest))
        (tmp_path / f"{name}.log").write_text(text + "".join(f"val acc {v}\n" for v in rest) + ("better acc 0.9 than 0.8\n" if name == "b" else ""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128MB", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = mt.read_ordered_log(spark, str(tmp_path)).collect()
            got = [(os.path.basename(r["file"])[0], r["number"], r["epoch"], list(r["batch_acc"])) for r in rows]
            assert sorted(got, key=lambda r: r[:2]) == want
            assert all(abs(sum(r["batch_acc"]) / 18 - r["val_acc"]) < 1e-8 for r in rows if r["epoch"] and r["batch_acc"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
