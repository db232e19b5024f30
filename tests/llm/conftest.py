import pytest

LONG = "word " * 30_000 + "x" * 50_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra
    columns whose names occur inside the operators."""
    rows = [
        (1, "one two three four", "en", "a", 18),
        (1, "one two three four", "en", "a", 18),
        (1, "another text under the same id", "de", "b", None),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 4),
        (5, LONG, "fr", "a", len(LONG)),
        (None, "a row without an id", "en", "a", 19),
        (None, "a row without an id", "en", "a", 19),
        (6, "ünïcode 𝔘 text with émojis 🙂 twice 🙂", "fr", None, 37),
    ]
    wide = [(*r, i, "k", 0.5, "h", "r") for i, r in enumerate(rows)]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "row int, key string, score double, text_hash string, component string"
    )
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
