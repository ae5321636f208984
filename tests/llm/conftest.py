import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
#: (doc_id, text, lang, source): nulls in every column, empty and very long texts, ties, repeated rows.
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away.", "en", "a"),
    (2, "The quick  brown\tfox jumps over the lazy dog and runs far away.", "en", "a"),
    (2, "The quick  brown\tfox jumps over the lazy dog and runs far away.", "en", "a"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (None, "The quick brown fox jumps over the lazy dog and runs far away.", "en", None),
    (None, None, None, None),
    (5, " \t\n ", "en", "b"),
    (6, LONG, "en", "b"),
    (7, LONG + " tail", None, "b"),
    (8, "1234 567 !!", "de", "b"),
    (9, "Größe 日本語 ▁ \x00 'tis it’s don't", "de", "b"),
    (10, "two words", "de", "c"),
    (11, "TWO words", "de", "c"),
]
#: Extra columns whose names clash with those that the operators use.
EXTRA = ["kept", "n", "class", "decon", "language", "quality_check", "piece_ids", "host", "rule", "lines", "site", "id", "ids", "start", "dedup_lines", "Dedup_Dropped", "site_key", "salt", "salts", "bad_lines", "kept_lines",
         "seed", "runs", "items", "wanted", "t1", "t2", "hash_a", "pages", "bad", "key", "c"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text")).withColumns({c: F.lit(f"x-{c}") for c in EXTRA})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
