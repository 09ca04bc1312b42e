import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, rank long, size int, _size string, digest string"
#: Nulls in every column, empty and blank texts, a long one, ties, repeated rows.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a", 46),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", None, 4),
    (5, "ALPHA beta gamma delta epsilon zeta eta theta.", "en", "b", 46),
    (6, "Straße ÉTÉ naïve — 東京 😀 words here and there", "de", "b", 10),
    (7, "word " * 6_000, "en", "b", 30_000),
    (8, "x" * 20_000, "en", "c", 20_000),
    (9, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a", 46),
    (9, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a", 46),
    (None, "Null keyed document with a handful of plain words in it", "en", "a", 55),
    (None, None, "en", "a", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 5, 6, "s", "d") for r in ODD], EXTRA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest table, with whole texts."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
