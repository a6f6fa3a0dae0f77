"""Small tables for the tests of the llm operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, counts string, score string, found string, row string"


def documents(spark, texts, ids=None, langs=None):
    """A documents table with extra columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, "en" if langs is None else langs[i], "s", len(t or ""), "x", "x", "x", "x")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sf_dir(spark, folder, **tables):
    """A folder of parquet tables to run a registered query on."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
