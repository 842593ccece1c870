import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, an empty text, white space only, repeated rows, a long text.
ODD = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, " \t\n", "en", "", 3),
    (4, "one two", "en", "a", 7),
    (4, "one two", "en", "a", 7),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "Ünïcödé — 𝔘𝔫𝔦 text’s 42nd don't <|endoftext|> x", "de", "b", 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
