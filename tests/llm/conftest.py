import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, id long, tag long, label long"

#: Nulls in any column, empty and blank texts, ties, repeated rows, a long text, and extra columns whose names clash.
ODD = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 1, 0.5, "r", 1, 1, 1),
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 1, 0.5, "r", 1, 1, 1),
    (2, "The cat sat on the mat and  looked at the dog. ", "en", "b", 1, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, None, None, None, None, None),
    (5, " \t\n", None, "b", 3, None, None, None, None, None),
    (6, "word " * 30_000, "en", None, 150_000, 1.0, "x", 9, 9, 9),
    (7, "Der Hund schläft, während die Katze über das Dach läuft.", "de", "c", 5, None, None, None, None, None),
    (8, "x", "de", "c", 1, None, None, None, None, None),
    (None, "a text without an id", "en", "a", 2, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None),
    (10, "THE CAT sat on the mat and looked at the dog.", "en", "a", 1, None, None, None, None, None),
    (11, "😀 ünïcödé \x00   ΣΣ", "fr", "d", 2, None, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (7, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    """{doc_id: text} of the smallest tables."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
