import pytest

LONG = "the quick brown fox jumps over the lazy dog near a quiet river bank today " * 3
PAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, " \t\n"), (None, LONG), (None, None),
        (6, PAGE + " tail"), (7, "head " + PAGE), (8, "x" * 20000), (9, "word " * 3000), (10, "ΑΣ <s>[INST] \\ é"),
        (11, "Released under the MIT License. you idiot"), (12, LONG + "extra")]
    full = [(i, t, None if n % 2 else "en", None, n, "a", 1, "k", "c") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, copy string, row long, "
              "token string, class_id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, i % 2) for i in range(1, 13)] + [(1, None, None), (None, 1, 1), (11, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "abc"), (None, LONG)]
    return spark.createDataFrame(rows, "item_id long, text string")
