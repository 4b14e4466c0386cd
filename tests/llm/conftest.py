import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, h1 string, row string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here today"
ODD = [
    (1, BASE, "en", "a", 1, 1, "x", "y"),
    (2, BASE, "en", "a", 1, 1, "x", "y"),
    (2, BASE, "en", "a", 1, 1, "x", "y"),
    (3, BASE + " again", None, "b", None, None, None, None),
    (4, None, "en", "a", 1, 1, "x", "y"),
    (5, "", "en", None, 1, 1, "x", "y"),
    (6, " \t\n ", "en", None, 1, 1, "x", "y"),
    (7, "one two", "en", "b", 1, 1, "x", "y"),
    (8, "ONE two", "en", "b", 1, 1, "x", "y"),
    (None, BASE, "en", "a", 1, 1, "x", "y"),
    (None, None, None, None, None, None, None, None),
    (9, LONG, "en", "a", 1, 1, "x", "y"),
    (10, LONG + " tail\nshort\n", "en", "a", 1, 1, "x", "y"),
    (11, "Shared Line of text\nother\n\n  shared line OF text\t\nend é É", "fr", "c", 1, 1, "x", "y"),
    (12, "shared line of text\r\nplain\nanother line here", "fr", "c", 1, 1, "x", "y"),
    (13, "This work is under the MIT License. Licensed under CC BY-NC 4.0. GNU General Public License", "en", "c", 1, 1, "x", "y"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
