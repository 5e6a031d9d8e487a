import pytest

from stratasift.llm.common import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, clashing column names, one long text."""
    long = "word " * 60_000 + "end"
    rows = [
        (1, "a b c", "q", 0.5),
        (1, "a b c", "q", 0.5),
        (None, None, "r", 1.0),
        (None, "x y token = \"abcdefgh1234\"", "s", None),
        (3, "", "t", 2.0),
        (4, long, None, 3.0),
        (5, long, None, 3.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
