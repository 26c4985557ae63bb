"""The fixed requests, all the way to leads."""

import duckdb
import pytest

from rillflow.plans import leads


@pytest.mark.parametrize("name", list(leads.GOLDEN))
def test_fixed_requests_come_to_the_known_result(spark, name):
    got = getattr(leads, name)(spark, None)
    held = duckdb.sql(leads.GOLDEN[name])
    order = [held.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in held.fetchall()), key=repr)
