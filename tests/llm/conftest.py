import pytest
from llm_support import ODD, SCHEMA, row


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)
