import pytest
from oracle import compare, connect

from asoflow.plans import registry

SF = "/root/testdata/sf0.001"
#: queries of which the smallest tables have no row: there are no runs of four days
EMPTY = {"jn20_truth_census"}
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    found = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert found is None or (found == "no rows" and name in EMPTY), found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    found = rows.collect()
    assert found and all(any(v is not None for v in r) for r in found)
