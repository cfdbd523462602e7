import pytest
from sample import BASE, COLUMNS, OTHERS, TEXTS, words


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty texts, copies, near copies, repeated rows, rows without an id, and columns with names that operators use inside."""
    rows = [(i, t, *OTHERS) for i, t in enumerate(TEXTS)] + [(None, "no id", *[None] * 14), (None, "no id", *[None] * 14), (3, BASE, *OTHERS), (7, words(3, 3000), *OTHERS)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
