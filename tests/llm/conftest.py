import pytest

AWKWARD = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, shard int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like results."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog today", "a", "en", 1, 7, 0.5, 3),
        (1, "the quick brown fox jumps over the lazy dog today", "a", "en", 1, 7, 0.5, 3),
        (2, "the quick brown fox jumps over the lazy dog today", None, None, None, None, None, None),
        (3, None, "b", "en", None, 1, 0.1, 0),
        (4, "", "b", "en", 0, 1, 0.1, 0),
        (5, " \t\n ", "b", "en", 4, 1, 0.1, 0),
        (6, long_text, "b", "en", 4, 1, 0.1, 0),
        (7, long_text + " and more", "c", "en", 4, 1, 0.1, 0),
        (None, "only two", "c", "en", 4, 1, 0.1, 0),
        (None, None, None, None, None, None, None, None),
        (8, "Größe Ünï ümlaut ſ K  nbsp  em", "c", "de", 4, 1, 0.1, 0),
    ]
    return spark.createDataFrame(rows, AWKWARD)
