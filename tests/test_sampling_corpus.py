"""Sampling, splitting, batching and corpus invariants."""
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.operators import corpus as cp
from tagloom.operators import sampling as sp
from tagloom.sources import driver

SF = "/root/testdata/sf0.001"


def test_dense_rank_equals_row_number(spark):
    df = spark.range(3000).withColumn("h", sp.hash_key("id"))
    got = sp.dense_rank_by_hash(df, "h", "id").select("id", "idx")
    ref = df.select("id", (F.row_number().over(Window.orderBy("h", "id")) - 1).alias("ref"))
    assert got.join(ref, "id").filter(F.col("idx") != F.col("ref")).count() == 0


def test_split_disjoint_exhaustive(spark):
    r = driver.reviews(spark, SF)
    s = sp.split_90_10(r)
    assert s.count() == r.count()
    assert {x["split"] for x in s.select("split").distinct().collect()} <= {"train", "val"}


def test_batches_full_but_last(spark):
    b = sp.batches(sp.split_90_10(spark.range(1000)))
    sizes = b.groupBy("split", "batch_id").count().collect()
    for split in ("train", "val"):
        ss = sorted((r["batch_id"], r["count"]) for r in sizes if r["split"] == split)
        assert all(c == 40 for _, c in ss[:-1]) and 0 < ss[-1][1] <= 40


def test_batches_in_place(spark):
    """Full batches over any number of partitions, every row once; repeated and null keys and splits are rows too."""
    ids = spark.range(0, 1003, 1, 7).select(F.when(F.col("id") % 11 > 0, F.col("id") % 500).alias("id"), F.col("id").alias("row"),
                                            F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, "a").otherwise("b")).alias("split"))
    b = sp.batches_in_place(ids)
    assert b.columns == ["id", "row", "split", "batch_id"]
    rows = b.collect()
    assert sorted(r["row"] for r in rows) == list(range(1003))
    for split in ("a", "b", None):
        n = Counter(r["batch_id"] for r in rows if r["split"] == split)
        total = sum(n.values())
        assert sorted(n) == list(range(-(-total // 40))) and all(n[k] == 40 for k in list(sorted(n))[:-1])
    first = {r["row"] for r in rows if r["split"] == "a" and r["batch_id"] == 0}
    assert first != set(sorted(r["row"] for r in rows if r["split"] == "a")[:40])         # shuffled inside the partition
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(split" not in plan
    assert sp.batches_in_place(ids.limit(0)).collect() == []
    assert [r["batch_id"] for r in sp.batches_in_place(ids.withColumn("batch_id", F.lit("x")).limit(1)).collect()] == [0]


def test_sample_with_replacement_size(spark):
    df = spark.range(123)
    assert sp.sample_with_replacement(df).count() == 246


def test_empty_dataset_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        cp.require_rows(cp.schema_seed(spark), "seed")


def test_entity_replace_keeps_lengths(spark):
    from tagloom.functions import bio
    from tagloom.operators import augment as ag
    r = driver.reviews(spark, SF).withColumn("labels", bio.bio_split("BIO_anno"))
    # project, then compare on the driver: a filter on these columns would be pushed below
    # the projections and inline the whole per-row expression (see README, caveats)
    rows = ag.with_entity_replaced(r).select(F.length("new_text").alias("a"), F.size("new_labels").alias("b")).collect()
    assert rows and all(x["a"] == x["b"] for x in rows)
    one = spark.createDataFrame([(1, "工行好", ["B-BANK", "I-BANK", "O"])], "id long, text string, labels array<string>")
    row = ag.with_entity_replaced(one).collect()[0]
    assert row["new_text"].endswith("好") and row["new_labels"][0] == "B-BANK"
    assert row["new_labels"][-1] == "O" and len(row["new_labels"]) == len(row["new_text"])


def test_brackets_reach_han_text_and_a_replacement_can_be_given(spark):
    from pyspark.sql import functions as F
    from tagloom.operators import augment as ag
    df = spark.createDataFrame([(i, "工商银行很好 ok", ["B-BANK"] + ["I-BANK"] * 3 + ["O"] * 5) for i in range(50)],
                               "id long, text string, labels array<string>")
    rows = ag.with_brackets(df, p=0.5).collect()
    assert sum("<" in r["new_text"] for r in rows) > 40
    assert all(len(r["new_text"]) == len(r["new_labels"]) and r["new_text"].replace("<", "").replace(">", "") == r["text"] for r in rows)
    row = ag.with_entity_replaced(df, choose=lambda mention, n: F.concat(F.lit("x"), mention)).first()
    assert row["new_text"] == "x工商银行很好 ok" and row["new_labels"] == ["B-BANK"] + ["I-BANK"] * 4 + ["O"] * 5


def test_draws_use_sixty_bits(spark):
    from pyspark.sql import functions as F
    from tagloom.operators import sampling as sp
    top = spark.range(2000).select(sp.hash_int(F.md5(F.col("id").cast("string"))).alias("h")).agg(F.max("h")).first()[0]
    assert (1 << 59) < top < (1 << 60)


def test_draws_are_rows(spark):
    """Repeated and null keys: still exactly 2N draws, each of an existing row."""
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "d"), (2, "e"), (3, "f")] * 4
    df = spark.createDataFrame(rows, "id long, v string")
    got = sp.sample_with_replacement(df).collect()
    assert sorted(r["draw"] for r in got) == list(range(2 * len(rows)))
    assert {(r["id"], r["v"]) for r in got} <= set(rows)
    keys = sp.sample_with_replacement(df.select("id")).collect()
    assert sorted(r["draw"] for r in keys) == list(range(2 * len(rows)))


def _mentions(spark):
    labels = ["B-BANK", "I-BANK", "O", "B-BANK", "O", "B-PRODUCT"]
    rows = [(i % 40 if i % 9 else None, "工行好招卡卡", labels) for i in range(120)] + [(7, "", []), (8, "好", ["O"]), (9, None, None)]
    return spark.createDataFrame(rows, "id long, text string, labels array<string>")


def test_lexicon_table_gives_the_fixed_pool_rows(spark):
    """Repeated and null ids, empty and null texts; the table's rows in any order and partitions."""
    from tagloom.operators import augment as ag
    df = _mentions(spark)
    pool = spark.createDataFrame(list(enumerate(ag.alias_pool())), "pos int, alias string").repartition(5)
    show = lambda d: sorted(map(str, d.select("id", "text", "new_text", "new_labels").collect()))
    want = show(ag.with_entity_replaced(df))
    assert show(ag.with_lexicon_replaced(df, pool, ["pos"])) == want
    half = ag.with_lexicon_replaced(df, pool, ["pos"], p=0.5)
    assert show(half) == show(ag.with_entity_replaced(df, p=0.5)) != want and half.columns == df.columns + ["new_text", "new_labels"]
    rows = ag.with_lexicon_replaced(df, pool.where("pos < 0"), ["pos"]).where("text is not null").collect()
    assert all(r["new_text"] == r["text"] and r["new_labels"] == r["labels"] for r in rows)


def test_lexicon_of_a_million_aliases_and_weights(spark):
    from tagloom.operators import augment as ag
    big = spark.range(1_000_000).select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("alias"))
    df = spark.createDataFrame([(i, "工行", ["B-BANK", "I-BANK"]) for i in range(500)], "id long, text string, labels array<string>")
    got = ag.with_lexicon_replaced(df, big, ["id"])
    h = F.md5(F.concat(F.lit("118:"), F.col("id").cast("string"), F.lit(":1")))
    assert got.where(F.col("new_text") != F.concat(F.lit("a"), F.pmod(sp.hash_int(h), F.lit(1_000_000)).cast("string"))).count() == 0
    assert got.count() == 500
    twice = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "pos int, alias string")
    n = {r["new_text"]: r["count"] for r in ag.with_lexicon_replaced(df, twice, ["pos"]).groupBy("new_text").count().collect()}
    assert set(n) == {"x", "y"} and 280 < n["x"] < 390


def test_dense_index_counts_every_row(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("a"), F.lit("s").alias("s")).repartition(7)
    got = [tuple(r) for r in sp.dense_index(df, ["a"]).collect()]
    assert sorted(r[2] for r in got) == list(range(5000))
    assert [a for a, _s, _i in sorted(got, key=lambda r: r[2])] == sorted(a for a, _s, _i in got)
    assert sp.dense_index(df.limit(0), ["a"]).count() == 0
