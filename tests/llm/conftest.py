import pytest


@pytest.fixture(scope="session")
def tables(spark):
    """A data frame from rows with a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
