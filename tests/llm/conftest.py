import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id long, `size.x` int, shingles string"


@pytest.fixture
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"wort{i % 977}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma.\nAlpha beta gamma.", "en", "a", 1, 1, 1, "x"),
        (1, "Alpha beta gamma.\nAlpha beta gamma.", "en", "a", 1, 1, 1, "x"),
        (2, None, "en", None, None, None, None, None),
        (3, "", None, "a", 0, 1, 1, "x"),
        (4, " \t\n ", "de", "b", 0, 1, 1, "x"),
        (5, long, "de", "b", 0, 1, 1, "x"),
        (None, "no id here at all", "en", "a", 0, 1, 1, "x"),
        (None, None, None, None, None, None, None, None),
        (6, "1234 5678 ###", "en", "c", 0, 1, 1, "x"),
        (7, long, "de", "b", 0, 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
