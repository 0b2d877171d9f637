import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens string"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t ", None, None, 5), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3),
        (6, long, "en", "s", len(long)), (7, "é ü 日本 😀 \x00 <|endoftext|> <s>", "fr", "s", 9), (8, "a b c d e f g h i j k l", "en", "s", 1),
        (8, "a b c d e f g h i j k l", "en", "s", 1), (None, "text without a number", "en", "s", 1),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
