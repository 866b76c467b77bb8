"""Every signal query against DuckDB, and rows where SQL can't express it."""

import pytest

from framewright.plans.registry import ORACLES, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    done = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert [x for x in differences(done, connect(sf_dir), ORACLES[name]) if "timestamp" not in x] == []
    else:
        assert done.count() > 0


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
