import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Make a DataFrame from rows and a schema in a few partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
