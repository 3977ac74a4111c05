import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and a column that clashes with names used inside."""
    rows = [
        (1, "the cat sat on the mat", "en", "a", 22, "x"),
        (1, "the cat sat on the mat", "en", "a", 22, "x"),
        (2, "", "en", "a", 0, None),
        (3, None, None, None, None, "y"),
        (None, "no id here at all", "en", "b", 17, "z"),
        (4, " \t\n\r ", "fr", "b", 5, "x"),
        (5, "wort " * 30_000, "de", "a", 150_000, "x"),
        (6, "A▁b  c\n\nÉcole\t\U0001F600", "fr", "c", 20, "x"),
        (7, "the cat sat on the mat", "en", "b", 22, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
