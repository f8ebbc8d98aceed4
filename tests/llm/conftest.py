import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Missing values in every column, empty and long texts, repeated rows, and columns whose names operators use."""
    rows = [
        (1, "", "en", "a", 7), (2, None, "en", None, None), (3, "one two three four five six seven", None, "a", 1),
        (3, "one two three four five six seven", None, "a", 1), (None, "mail me at x.y@example.com now", "en", "b", 2),
        (4, "word " * 60_000, "en", "b", 3), (5, "\x00 \x1f\u2003é\U0001f600\n\t", "de", "b", 4), (6, " \n", "de", "b", 4),
    ]
    return spark.createDataFrame(
        [(i, t, la, s, n, "x", "y", "z") for i, t, la, s, n in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row string, n_tokens string, rep string",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
