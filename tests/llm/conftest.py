import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, n long, bit long, score double, key long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang), with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 1, 2, 0.5, 3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls in every column, empty and blank texts, repeated rows, one very long text.
ODD = [(None, None), (None, "some words of a text without an id"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "two words"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (7, "long " * 60000), (8, "ÆØÅ ß İ ☃ \U0001f600"), (9, "mail a@b.co and 10.0.0.1")]


@pytest.fixture
def odd():
    return ODD
