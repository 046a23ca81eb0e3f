import pytest

from fleetgrid.llm import entries


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_rows_as_sql(name, agrees):
    assert agrees(entries.queries()[name], entries.oracle_sql()[name]) > 0
