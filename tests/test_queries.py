import pytest
from compare import check, connect

from tarnlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    check(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
