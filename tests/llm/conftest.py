import pytest
from llm_cases import SCHEMA, document_rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
