import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, long and repeated texts, a repeated row, clashing names."""
    rows = [(1, "a b c d e f g", "en", "web", 13), (2, None, "en", "web", None), (3, "", None, None, 0), (4, LONG, "en", "web", len(LONG)), (5, LONG, "de", None, len(LONG)), (None, "no id here", "en", "web", 10), (7, " \n\t ", "fr", "web", 4), (1, "a b c d e f g", "en", "web", 13), (8, "two words", None, "book", 9)]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.selectExpr("*", "'x' AS id", "1 AS key", "0.5 AS score", "true AS kept", "'y' AS component", "1 AS node", "'z' AS tokens", "0 AS probability")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
