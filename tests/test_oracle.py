"""Every query of the core beside its SQL, on the smallest tables."""

import oracle
import pytest

from quillstream.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


# Queries that find nothing in the smallest tables; their tests have fixtures.
NO_ROWS = {"quarantined_units"}


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, con, name):
    assert oracle.compare(QUERIES[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    """All columns of all rows are made, so that nothing is left out of the plan; some queries have no rows here."""
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    rows = df.collect()
    assert all(len(r) == len(df.columns) for r in rows)
    assert rows or name in NO_ROWS


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
