"""Queries over navaids read all orders, also where there are more than 1,500."""

import duckdb
import pytest

from skylattice import queries
from skylattice.plans.derived import VIEWS, derived

WIDE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["raw_navaids", "navaids"])
def test_all_orders(spark, name):
    supported = "WHERE o_orderkey % 9 >= 2" if name == "navaids" else ""
    told = duckdb.sql(f"SELECT count(*) FROM read_parquet('{WIDE}/orders.parquet') {supported}").fetchall()[0][0]
    assert derived(spark, WIDE, name).count() == told and told > 1500


def test_same_places(spark):
    """Spark and DuckDB give the same coordinates, those of the first 1,500 keys within one field."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{WIDE}/orders.parquet')")
    told = con.sql(f"SELECT k, latitude, longitude FROM ({VIEWS['raw_navaids']}) ORDER BY k").fetchall()
    assert told == [tuple(r) for r in derived(spark, WIDE, "raw_navaids").select("k", "latitude", "longitude").orderBy("k").collect()]
    assert all(25 <= a < 50 and -125 <= b < -65 for k, a, b in told if k < 1500) and all(-75 <= a < 75 and -125 <= b < 115 for _, a, b in told)


def test_counts_grow(spark):
    assert queries.snapshot_counts(spark, WIDE).first()["raw"] == 15_000
