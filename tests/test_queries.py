"""Every query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry
from skylattice import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def test_route_plans(spark, sf_dir):
    plans = {r["request_id"]: r for r in queries.route_plans(spark, sf_dir).collect()}
    best = {r["request_id"]: r for r in queries.optimal_route(spark, sf_dir).collect()}
    assert len(plans) == 350 and set(best) <= set(plans)
    for k, r in best.items():
        assert (plans[k]["status"], plans[k]["legs"], plans[k]["total_nm"]) == (r["status"], r["legs"], r["total_nm"])
    one = {r["request_id"]: r["total_nm"] for r in queries.one_navaid_route(spark, sf_dir).collect()}
    assert all(plans[k]["total_nm"] <= t + 1e-6 for k, t in one.items())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 171
