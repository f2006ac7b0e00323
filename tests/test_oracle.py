"""Every SQL-checkable registered query against its DuckDB oracle (sf0.001).

Same gate as the driver's check: row count, column names and an
order-insensitive hash of the values.
"""

import pytest

from ratewise.plans.catalog import load_all
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SQL_QUERIES = sorted(n for n, e in load_all().items() if e.sql is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(spark, con, name):
    e = load_all()[name]
    res = compare(spark, con, name, e.fn, e.sql, SF)
    assert res["status"] == "ok", res
