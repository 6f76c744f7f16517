"""What keeps work and memory bounded as tables grow: copies counted, not expanded; nothing sent whole."""

import json
import threading

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from skylattice import producer_queries, queries
from skylattice.functions import canonical
from skylattice.operators import integrity
from skylattice.plans import search
from skylattice.sources import pages
from skylattice.tables import spread, together


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _navaids(spark, rows):
    return spark.createDataFrame(rows, "database_id string, identifier string, family string, latitude double, longitude double, published_range_nm double")


def test_edges_and_degrees_send_no_side_whole(spark, sf_dir):
    for df in (queries.navigable_edges(spark, sf_dir), queries.degree_by_navaid(spark, sf_dir)):
        assert "BroadcastHashJoin" not in _plan(df)


def test_degrees_count_copies(spark):
    """Copies of one place and range, of one place and another range, lone and rangeless ones."""
    rows = [(f"{i:03d}", "N", "VOR", float(i % 4), float(i % 3), (30.0, 60.0)[i % 2]) for i in range(60)]
    n = _navaids(spark, [*rows, ("far", "F", "VOR", 60.0, 60.0, 50.0), ("none", "Z", "VOR", 0.0, 0.0, None)])
    told: dict = {}
    for r in search.navigable_edges(n).collect():
        for x in (r["a"], r["b"]):
            told[x] = told.get(x, 0) + 1
    assert {r["database_id"]: r["degree"] for r in search.degrees(n).collect()} == told and "far" not in told


def test_fronts_keep_what_ties_need(spark):
    n = _navaids(spark, [("3", "B", "VOR", 1.0, 1.0, 90.0), ("2", "B", "VOR", 1.0, 1.0, 90.0), ("1", "C", "VOR", 1.0, 1.0, 40.0), ("4", "A", "VOR", 1.0, 1.0, 40.0), ("5", "A", "VOR", 2.0, 1.0, None), ("6", "D", "VOR", 2.0, 1.0, float("nan")), ("7", "E", "VOR", 2.0, 1.0, 10.0)])
    kept = {r["database_id"]: r["stands"] for r in search.fronts(n).collect()}
    assert kept == {"2": 4, "4": 0, "7": 3, "5": 0}


def test_repeated_texts_are_parsed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(canonical, "canonical_or_none", lambda t: seen.append(t) or (t and t.upper()))
    assert canonical.canonical_json.func(pd.Series(["a", None, "a", "b"] * 9)).tolist() == ["A", None, "A", "B"] * 9 and len(seen) == 3


def test_costly_rows_are_dealt_out(spark, monkeypatch):
    one = spark.range(1000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("skylattice.tables.SPREAD", 10)
    assert spread(one).rdd.getNumPartitions() == 100


def test_filters_in_one_pass(spark, sf_dir):
    assert _plan(queries.QUERIES["list_filters"](spark, sf_dir)).count("Scan parquet") == 3
    assert _plan(queries.QUERIES["airspace_filters"](spark, sf_dir)).count("Scan parquet") == 1
    rows = producer_queries._typed(spark, sf_dir)
    asked = {"c": {"country": "C7"}, "s": {"search": "customer#0000001", "type": [1, 2]}, "b": {"box": (170.0, -20.0, -170.0, 20.0)}, "w": {"within": (45.0, 10.0, 2_500_000.0)}}
    got = sorted((r["filter"], r["id"]) for r in pages.matched(rows, "navaid", asked).selectExpr("filter", "r._id as id").collect())
    assert got == sorted((name, r["id"]) for name, how in asked.items() for r in pages.selected(rows, "navaid", **how).selectExpr("r._id as id").collect()) and got


def test_navaids_of_one_place_are_met_together(spark, monkeypatch):
    """Pairs as by comparing all: many at one place in rows of a few, ranges of several classes, an id
    that stands twice (with ranges of two classes, which paired it with itself)."""
    monkeypatch.setattr(search, "TOGETHER", 3)
    rows = [(f"{i:02d}", "N", "VOR", (10.0, 10.4, 10.0, 12.0)[i % 4], (5.0, 5.0, 5.3, -179.9)[i % 4], (30.0, 8.0, 60.0, 5.0, 20.0)[i % 5]) for i in range(40)]
    rows += [("04", "N", "VOR", 10.0, 5.0, 40.0), ("90", "N", "VOR", 12.0, 179.9, 9.0), ("91", "N", "VOR", None, 5.0, 50.0), ("92", "N", "VOR", 10.0, 5.0, None), ("93", "N", "VOR", float("nan"), 5.0, 50.0)]
    told = spark.createDataFrame(rows, "id string, n string, f string, lat double, lon double, reach double")
    a, b = (told.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "lat", "lon", "reach")]) for s in "ab")
    told = a.crossJoin(b).filter("id_a < id_b").withColumn("nm", search.geo.haversine_nm("lat_a", "lon_a", "lat_b", "lon_b")).filter("nm <= reach_a + reach_b and reach_a > 0 and reach_b > 0")
    got = sorted(map(tuple, search.navigable_edges(_navaids(spark, rows)).collect()))
    assert got == sorted(map(tuple, told.select("id_a", "id_b", "nm").collect())) and len(got) > 300


def test_search_inputs_look_for_pairs_once(spark, sf_dir):
    joins = [_plan(queries.QUERIES[q](spark, sf_dir)).count("SortMergeJoin [cell") for q in ("navigable_edges", "search_inputs")]
    assert joins[0] == joins[1] > 0


def test_two_navaids_of_one_place(spark, tmp_path, sf_dir):
    """A route over two navaids of one place counts: orders whose places repeat, against SQL."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT k * 7 + i * 180000 AS o_orderkey FROM range(200) t(k), range(3) c(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"COPY (FROM '{sf_dir}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    for t in ("orders", "nation"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    told = sorted(con.sql(queries.ORACLES["two_navaid_route"]).fetchall())
    got = {r["request_id"]: r["total_nm"] for r in queries.two_navaid_route(spark, str(tmp_path)).collect()}
    assert got.keys() == {k for k, _ in told} and all(abs(got[k] - t) < 2e-6 for k, t in told) and told


def test_json_writes_most_texts(monkeypatch):
    """The canonical text as canonical_text gives it, which plain texts don't need."""
    values = ['{"b": [1.50, -0.0, 1e400, 100.0], "a": "x"}', '{"b":[1.50,-0.0,100.0,-39.879999999999995],"A":{"_":-0,"a":null}}', "9007199254740992.0", "9007199254740993", "1e21", "1e-7", "0.000001", '{"a":1,"a":2}', '{"\\u00e9":1}', '{"é":1,"z":"\\t"}', "[NaN]", "[" * 300 + "]" * 300, "x", "", None]
    slow = []
    for t in values:
        try:
            slow.append(t if t is None else canonical.canonical_text(json.loads(t, object_pairs_hook=canonical._unique, parse_constant=canonical._refuse)))
        except ValueError:
            slow.append(None)
    assert [canonical.canonical_or_none(t) for t in values] == slow
    monkeypatch.setattr(canonical, "canonical_text", None)
    assert canonical.canonical_or_none(values[1]) == '{"A":{"_":0,"a":null},"b":[1.5,0,100,-39.879999999999995]}'


def test_jobs_run_side_by_side():
    barrier = threading.Barrier(3, timeout=10)
    assert sorted(together(*[barrier.wait] * 3)) == [0, 1, 2]


def test_faults_of_pairs_without_a_shuffle(spark):
    """Rows of many pairs give the counts that the pairs one by one give, and aren't dealt out by pair."""
    rows = [[("1", "2", 1.0), ("1", "2", -1.0), ("2", "1", 3.0), ("2", "1", 3.0), ("2", "1", None)], [("3", "4", float("nan")), ("5", None, float("inf")), (None, "5", 0.0), (None, "5", 0.0)], [], [("6", "7", 0.0)], [("11", "2", 1.0), ("1", "12", 1.0)]]
    blocks = spark.createDataFrame([(r,) for r in rows], "pairs array<struct<a: string, b: string, nm: double>>")
    near = spark.createDataFrame([("q", "1", "VOR", 1.0, 1.0, 1.0)], "request_id string, database_id string, family string, dep_nm double, arr_nm double, published_range_nm double")
    counts = integrity.search_faults(near, blocks)
    assert counts.first() == integrity.search_faults(near, blocks.select(F.inline("pairs"))).first() and counts.first()["repeated_pairs"] == 3
    assert "hashpartitioning(a" not in _plan(counts)


def test_rows_of_pairs_have_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 3)
    n = _navaids(spark, [(f"{i:02d}", "N", "VOR", (10.0, 10.4, 12.0)[i % 3], 5.0, (30.0, 8.0, 60.0)[i % 4 % 3]) for i in range(40)])
    got = sorted(map(tuple, search.edge_blocks(n).select(F.inline("pairs")).collect()))
    assert got == sorted(map(tuple, search.navigable_edges(n).collect())) and got
    assert "hashpartitioning(a" not in _plan(queries.QUERIES["search_inputs"](spark, sf_dir))
