"""Every query with SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle_check
from quillsieve.plans import all_queries, registry  # noqa: F401 - importing registers the queries

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="session")
def con(sf_dir):
    return oracle_check.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees(spark, con, sf_dir, name):
    assert not oracle_check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 128
