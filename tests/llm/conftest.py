import pytest

DOCS = "doc_id long, text string, lang string, source string, extra int"
LONG = " ".join(f"word{i}" for i in range(3000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and a column that clashes."""
    near = LONG.replace("word1500", "changed")
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 1), (None, "no id here at all friends", "en", "a", 1),
        (4, LONG, "en", "a", 2), (5, near, "en", "b", 2), (6, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1), (6, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (7, "!!! ...", "de", "a", 3), (8, "one two", "de", "a", 3), (9, "one two", None, "a", 3),
    ]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "shard")
