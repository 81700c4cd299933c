import pytest


@pytest.fixture
def frame(spark):
    """Rows to a table; a plain way to write small ones."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
