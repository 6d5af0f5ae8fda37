"""Every query with SQL gives the SQL's rows on the smallest tables."""

import oracle
import pytest

from tidemark.plans import registry

PLANS, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, folder, con, name):
    assert oracle.compare(spark, PLANS[name], SQL[name], folder, con) == ""


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs_alike_twice(spark, folder, name):
    first, second = (oracle.table(x.columns, x.collect()) for x in (PLANS[name](spark, folder), PLANS[name](spark, folder)))
    assert first[1] and first == second


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
