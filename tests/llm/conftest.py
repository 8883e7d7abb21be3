import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, and extra columns with clashing names."""
    texts = [
        None, "", " \n\t ", "one", "A b C d", "a B c d", PASSAGE, PASSAGE, "x " + PASSAGE + " y", PASSAGE.upper(), LONG, LONG + " end",
        "Élan vital é à ü", "#*$ && || %% " * 20, "same line\n" * 30, "Licensed under the Apache License, Version 2.0.", "don't <|endoftext|> we'll\u00a0go",
    ]
    langs, sources = ["en", "fr", None], ["s1", None, "s0", ""]
    rows = [(i, t, langs[i % 3], sources[i % 4], None if i % 2 else 3) for i, t in enumerate(texts)]
    rows += [rows[6], rows[7]]
    extra = [(*r, "x", 1, 2, 3, True, 4, 5, 6, "k", 7.0) for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "id string, row int, n_words int, start int, kept boolean, tid int, shard int, size int, key string, score double"
    return spark.createDataFrame(extra, f"{names}, {clash}")


@pytest.fixture(scope="session")
def unnamed(spark, odd):
    """The same with null ids among them."""
    from pyspark.sql import functions as F

    return odd.withColumn("doc_id", F.when(F.col("doc_id") % 4 != 1, F.col("doc_id")))


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def pairs():
    return lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def rows():
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
