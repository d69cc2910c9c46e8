"""Every query of the library runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import pytest
from support import DATA, same

from tidewater.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).collect()
