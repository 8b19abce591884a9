import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_llm import ODD, table  # noqa: E402


@pytest.fixture
def odd(spark):
    """Nulls, empties, ties, a row twice, a null id, a very long text."""
    return table(spark, [*ODD, "word " * 30_000, ODD[4]], [0, 1, 2, 3, 4, 5, 6, None, 8, 4])


@pytest.fixture
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
