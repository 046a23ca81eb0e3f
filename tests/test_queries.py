import pytest

from fleetgrid.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, agrees):
    agrees(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(name, spark):
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and ("error" not in out.columns or out.filter("error is not null").count() == 0)
