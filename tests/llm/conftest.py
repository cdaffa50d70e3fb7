import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from llm_rows import EDGES, SCHEMA  # noqa: E402 - beside this file


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, a repeated row, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
