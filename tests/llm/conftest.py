import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return docs([
        (None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "same words here", "a"), (4, "same words here", "a"), (4, "other text", "b"),
        (5, "same words here", "b"), (6, long, "b"), (7, long + " end", "c"), (None, "x", "c"), (8, "İK ü 😀 +1 (609) 555-7932 a@b.c", ""),
    ])
