import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash."""
    rows = [
        (1, "The cat sat on the mat and the dog lay by the door all day.", "en", "a"),
        (1, "The cat sat on the mat and the dog lay by the door all day.", "en", "a"),
        (1, "Another text under the same number.", "en", "b"),
        (2, "", "en", None), (3, None, None, None), (None, "no number", "en", "a"), (None, None, None, None),
        (4, "   \t\n ", "en", "b"), (5, "x" * 300_000, "en", "c"), (6, "word " * 60_000, "en", "c"), (7, "Ça et là, déjà vu.", "fr", "b"),
        (8, "12345 !!! ???", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 9, "z", 1.5, 0, "q", 3) for r in rows], DOCS + ", shard int, Media string, SCORE double, copies int, n_words string, `size` int")
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
