import pytest

from ripplet.plans import catalog, changes, graphs, queue, reports, rules, wired  # noqa: F401
from tests.compare import duck, of_spark, of_sql

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, con, name):
    columns, rows = of_spark(catalog.QUERIES[name](spark, SF))
    expected, there = of_sql(con, catalog.ORACLES[name])
    assert columns == expected
    assert len(rows) == len(there)
    assert rows == there
