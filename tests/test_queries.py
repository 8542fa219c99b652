"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    mine = contract.queries()[name](spark, SF_DIR).toPandas()
    if name in SQL:
        assert differences(mine, con.execute(SQL[name]).fetchdf()) is None
    else:
        assert len(mine)
