"""Annotated CSV files: quoting, line breaks, and the first fault of every record."""
import pytest
from pyspark.sql import functions as F

from tagloom.sources import annotated as an

FILE = '''id,text,BIO_anno,class
1,ab c,B-BANK I-BANK O O,1
2,"a
b","O O B-PRODUCT",0
3,"say ""hi"", ok",O O O O O O O O O O O O,2
1,ab c,B-BANK I-BANK O O,1
4,abc,O O,1
5,abc,O O O,
6,,O,1
7,abc,,1
8,abc,O O O,7
9,abc,O B-CAR O,1
x,abc,O O O,1
10,abc,O O O,1,more
11,abc
,abc,O O O,1
12,卡好,B-PRODUCT B-COMMENTS_ADJ,1
'''


def test_every_record_is_sound_or_has_its_fault(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FILE)
    good, rejects = an.load(spark, str(tmp_path / "a.csv"))
    rows = sorted(tuple(r) for r in good.collect())
    assert rows == [(1, "ab c", "B-BANK I-BANK O O", 1)] * 2 + [(2, "a\nb", "O O B-PRODUCT", 0),
                                                                (3, 'say "hi", ok', " ".join("O" * 12), 2), (12, "卡好", "B-PRODUCT B-COMMENTS_ADJ", 1)]
    got = {(r["id"], r["problem"]) for r in rejects.collect()}
    assert got == {(4, "label count"), (5, "no class"), (6, "no text"), (7, "no labels"), (8, "class"), (9, "unknown label"),
                   (None, "malformed"), (10, "malformed"), (11, "malformed"), (None, "no id")}
    records = [r["record"] for r in rejects.where("problem = 'malformed'").collect()]
    assert sorted(records) == ["10,abc,O O O,1,more", "11,abc", "x,abc,O O O,1"]
    counted = an.read(spark, str(tmp_path / "a.csv")).groupBy("problem").agg(F.count(F.lit(1)).alias("n")).where("problem = 'malformed'")
    assert counted.first()["n"] == 3                      # whatever is selected


def test_written_reviews_come_back(spark, tmp_path):
    texts = ["a\r\nb", ' x "y" ', "tab\t,comma", "back\\slash", "卡 ", "#no", "'"]
    rows = [(i, t, " ".join("O" * len(t)), i % 3) for i, t in enumerate(texts)]
    an.write(spark.createDataFrame(rows, an.REVIEWS).repartition(3), str(tmp_path / "out"))
    good, rejects = an.load(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in good.collect()) == rows and rejects.count() == 0


def test_other_headers_raise_and_test_sets_have_two_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a\n\nb"\n2,\n3,c,d\n')
    good, rejects = an.load(spark, str(tmp_path / "t.csv"), labelled=False)
    assert [tuple(r) for r in good.collect()] == [(1, "a\n\nb")]
    assert {(r["id"], r["problem"]) for r in rejects.collect()} == {(2, "no text"), (3, "malformed")}
    (tmp_path / "u.csv").write_text("id,words\n1,a\n")
    with pytest.raises(Exception):
        an.load(spark, str(tmp_path / "u.csv"), labelled=False)
    (tmp_path / "e.csv").write_text("id,text\n")
    good, rejects = an.load(spark, str(tmp_path / "e.csv"), labelled=False)
    assert good.count() == rejects.count() == 0
