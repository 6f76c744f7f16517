"""The route search against exhaustive search and golden scenarios."""

import itertools
import random

import numpy as np
import pytest

from skylattice.plans import search
from skylattice.plans.legs import route_legs, warning_summary, warnings
from skylattice.plans.report import report
from skylattice.plans.search import best_route, next_limit, plan_routes
from skylattice.schema import AIRPORTS, NAVAIDS, REQUESTS
from skylattice.streaming.requests import plan_stream


@pytest.mark.parametrize("seed", range(60))
def test_best_route_is_the_exhaustive_one(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    nodes = {f"id{i}": (f"N{rng.randint(0, 3)}", rng.randint(1, 8), rng.randint(1, 9), rng.randint(1, 9)) for i in range(n)}
    # distances to both ends are consistent with those between nodes
    links: dict = {}
    for a, b in itertools.combinations(nodes, 2):
        d = max(abs(nodes[a][3] - nodes[b][3]), abs(nodes[a][2] - nodes[b][2]), rng.randint(1, 6))
        if rng.random() < 0.7:
            links.setdefault(a, []).append((b, d))
            links.setdefault(b, []).append((a, d))
    cap, every = rng.randint(5, 25), []
    for k in range(1, n + 1):
        for path in itertools.permutations(nodes, k):
            steps = [dict(links.get(a, [])).get(b) for a, b in itertools.pairwise(path)]
            if None in steps or nodes[path[0]][2] > nodes[path[0]][1] or nodes[path[-1]][3] > nodes[path[-1]][1]:
                continue
            total = nodes[path[0]][2] + sum(steps) + nodes[path[-1]][3]
            if total <= cap:
                every.append((total, k + 1, tuple((nodes[i][0], i) for i in path)))
    best = min(every, default=None)
    ids = sorted(nodes)
    number = {x: k for k, x in enumerate(ids)}
    pairs = sorted({(min(a, b), max(a, b), d) for a, near in links.items() for b, d in near})
    column = lambda k: np.array([float(nodes[x][k]) for x in ids])
    got = best_route([nodes[x][0] for x in ids], ids, column(1), column(2), column(3), np.array([number[a] for a, _, _ in pairs], np.int64), np.array([number[b] for _, b, _ in pairs], np.int64), np.array([float(d) for _, _, d in pairs]), float(cap))
    assert (None if got is None else (got[0], tuple((nodes[ids[k]][0], ids[k]) for k in got[1]))) == (None if best is None else (best[0], best[2]))


def test_limits():
    assert next_limit([1.1, 1.5], None, None) == 1.1 and next_limit([1.1, 1.5], 1.1, 1.2) == 1.2
    assert next_limit([1.1, 1.5], 1.2, 1.15) is None and next_limit([1.1, 1.5], 1.5, None) is None


def _planned(spark, airports, navaids, factor=1.5):
    nav = [(i, n, n, f, lon, lat, 112.0 if f != "NDB" else 300.0, "MHz" if f != "NDB" else "kHz", r, decl, var, "book" if var is not None else None, None) for i, n, f, lon, lat, r, decl, var in navaids]
    a = spark.createDataFrame([(c, c, c, lon, lat, decl) for c, lon, lat, decl in airports], AIRPORTS)
    n = spark.createDataFrame(nav, NAVAIDS)
    q = spark.createDataFrame([("q", airports[0][0], airports[1][0]), ("same", airports[0][0], airports[0][0]), ("none", airports[0][0], "ZZZZ"), ("bad", "12", None)], REQUESTS)
    return plan_routes(q, a, n, factor), n, q, a


def test_two_legs(spark):
    plans, navaids, _, _ = _planned(spark, [("AAAA", 0.0, 0.0, 5.0), ("BBBB", 30.0, 35.0, -2.0)], [("m", "MID", "VOR-DME", 10.0, 20.0, 1500.0, 3.0, 7.0)])
    rows = {r["request_id"]: r for r in plans.collect()}
    assert rows["q"]["total_nm"] == pytest.approx(2726.7400455011434, rel=1e-12) and rows["q"]["legs"] == 2
    assert [rows[k]["status"] for k in ("same", "none", "bad")] == ["identical-endpoints", "arrival-not-found", "invalid-request"]
    legs = route_legs(plans, navaids)
    one, two = sorted(legs.collect(), key=lambda r: r["leg"])
    assert one["departure_magnetic"] == pytest.approx(20.505550260982545) and one["arrival_magnetic"] == pytest.approx(24.273169556803623)
    assert one["arrival_guidance"] == pytest.approx(20.273169556803623) and one["departure_guidance"] is None and two["arrival_guidance"] is None
    codes = {r["code"]: r["n"] for r in warning_summary(warnings(legs, plans)).collect()}
    assert codes == {"facility-variation-date-unavailable": 2}
    text = report(plans, legs, "q")
    assert "Route Points: AAAA → MID → BBBB" in text and "Total Distance: 2726.7 NM" in text and report(plans, legs, "x") == "x: unknown\n"


def test_family_preference_and_fallback(spark):
    ends = [("AAAA", 0.0, 0.0, None), ("BBBB", 4.0, 0.0, None)]
    vor = [("a", "A", "VOR", 1.0, 1.0, 100.0, None, None), ("b", "B", "VOR", 3.0, 1.0, 100.0, None, None), ("n", "N", "NDB", 2.0, 0.0, 125.0, None, None)]
    row = _planned(spark, ends, vor)[0].filter("request_id = 'q'").first()
    assert row["mode"] == "vor-family" and [s["identifier"] for s in row["route"]] == ["A", "B"]
    plans, navaids, _, _ = _planned(spark, ends, [("a", "A", "VOR", 1.0, 0.0, 90.0, None, None), ("ndb-z", "N", "NDB", 3.0, 0.0, 90.0, None, None), ("ndb-a", "N", "NDB", 3.0, 0.0, 90.0, None, None)])
    row = plans.filter("request_id = 'q'").first()
    assert row["mode"] == "ndb-fallback" and [s["database_id"] for s in row["route"]] == ["a", "ndb-a"]
    assert warnings(route_legs(plans, navaids), plans).orderBy("rank").first()["code"] == "ndb-fallback-used"


def test_antimeridian_and_coverage(spark):
    over = _planned(spark, [("AAAA", 179.0, 0.0, None), ("BBBB", -179.0, 0.0, None)], [("m", "M", "VOR", 180.0, 0.0, 100.0, None, None)])[0]
    assert over.filter("request_id = 'q'").first()["status"] == "found"
    degree = 111194.92664455874 / 1852
    for reach, status in ((degree + 1e-9, "found"), (degree - 1e-6, "no-route")):
        plans = _planned(spark, [("AAAA", 0.0, 0.0, None), ("BBBB", 2.0, 0.0, None)], [("m", "M", "VOR", 1.0, 0.0, reach, None, None)])[0]
        assert plans.filter("request_id = 'q'").first()["status"] == status


def test_stream_of_requests(spark, tmp_path):
    _, navaids, requests, airports = _planned(spark, [("AAAA", 0.0, 0.0, None), ("BBBB", 2.0, 0.0, None)], [("m", "M", "VOR", 1.0, 0.0, 90.0, None, None)])
    requests.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        plan_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), airports, navaids, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["arrival-not-found", "found", "identical-endpoints", "invalid-request"]


def _world(spark, seed, n=120):
    """Navaids over a region, some NDBs, some in one place, and requests between five airports."""
    rng = random.Random(seed)
    spots = [(round(rng.uniform(0, 12), 1), round(rng.uniform(0, 8), 1)) for _ in range(n // 2)]
    navaids = [(f"n{i:02d}", f"N{rng.randint(0, 9)}", "NDB" if rng.random() < 0.3 else "VOR", *rng.choice(spots), rng.choice([40.0, 70.0, 110.0]), None, None) for i in range(n)]
    nav = [(i, name, name, f, lon, lat, 112.0 if f != "NDB" else 300.0, "MHz" if f != "NDB" else "kHz", r, None, None, None, None) for i, name, f, lon, lat, r, _, _ in navaids]
    places = [("AAAA", 0.0, 0.0), ("BBBB", 12.0, 8.0), ("CCCC", 0.0, 8.0), ("DDDD", 12.0, 0.0), ("EEEE", 6.0, 4.0)]
    airports = spark.createDataFrame([(c, c, c, lon, lat, None) for c, lon, lat in places], AIRPORTS)
    requests = spark.createDataFrame([(f"{a[0]}{b[0]}", a[0], b[0]) for a in places for b in places if a < b], REQUESTS)
    return requests, airports, spark.createDataFrame(nav, NAVAIDS)


@pytest.mark.parametrize("seed, pairs", [(0, 0), (1, 40)])
def test_joins_and_tasks_and_stages_agree(spark, monkeypatch, seed, pairs):
    """By joins (some or all requests), in tasks, in stages and at once: the same routes, down to
    the order of ties."""
    requests, airports, navaids = _world(spark, seed)
    told = lambda **how: {r["request_id"]: (r["status"], r["mode"], r["total_nm"], [s["database_id"] for s in r["route"] or []]) for r in plan_routes(requests, airports, navaids, **how).collect()}
    staged = told()
    assert told(pairs=pairs) == staged and any(len(v[3]) > 2 for v in staged.values())
    monkeypatch.setattr(search, "FACTORS", (1.5,))
    assert told() == staged


def test_what_a_stage_admits(spark):
    requests, airports, navaids = _world(spark, 1)
    resolved = search.resolve_airports(requests, airports)
    wide = {(r["request_id"], r["database_id"]): (r["dep_nm"] + r["arr_nm"]) / (r["limit_nm"] / 1.5) for r in search.candidates(resolved, navaids).collect()}
    done = None
    for f in search.FACTORS:
        ring = {(r["request_id"], r["database_id"]) for r in search.candidates(resolved, navaids, f, done).collect()}
        assert ring == {k for k, v in wide.items() if v <= f and (done is None or v > done)}
        done = f
    found = {r["request_id"]: r for r in search.discover(resolved, navaids).collect()}
    direct = {r["request_id"]: r["direct_nm"] for r in resolved.collect()}
    for q, r in found.items():
        assert r["factor"] == min(f for f in search.FACTORS if r["total_nm"] <= direct[q] * f) and search.FACTORS[r["stage"] - 1] == r["factor"]
        assert r["admitted"] == sum(k[0] == q and v <= r["factor"] for k, v in wide.items())


def test_pairs_of_fresh_navaids(spark):
    """Pairs met stage by stage are those of all navaids at once, each once."""
    _, _, navaids = _world(spark, 2)
    all_ = {(r["a"], r["b"]) for r in search.navigable_edges(navaids).collect()}
    half = navaids.withColumn("fresh", navaids["database_id"] >= "n60")
    old = {(r["a"], r["b"]) for r in search.navigable_edges(navaids.filter("database_id < 'n60'")).collect()}
    new = [(r["a"], r["b"]) for r in search.navigable_edges(half, "fresh").collect()]
    assert len(set(new)) == len(new) and set(new) | old == all_ and not set(new) & old


@pytest.mark.parametrize("pairs", [0, search.PAIRS])
def test_long_chain(spark, pairs):
    """A route over 25 navaids beside decoys out of everything's reach."""
    step = 0.2
    navaids = [(f"r{i:02d}", f"R{i:02d}", "VOR", i * step, float(i % 2 == 0), 13.0, None, None) for i in range(1, 50)] + [(f"d{i:02d}", f"D{i:02d}", "VOR", (i + 1) * step / 2, 2.0, 1.0, None, None) for i in range(99)]
    nav = spark.createDataFrame([(i, n, n, f, lon, lat, 112.0, "MHz", r, None, None, None, None) for i, n, f, lon, lat, r, _, _ in navaids], NAVAIDS)
    airports = spark.createDataFrame([("AAAA", "AAAA", "A", 0.0, 0.0, None), ("BBBB", "BBBB", "B", 50 * step, 0.0, None)], AIRPORTS)
    row = plan_routes(spark.createDataFrame([("q", "AAAA", "BBBB")], REQUESTS), airports, nav, pairs=pairs).first()
    assert row["status"] == "found" and [s["identifier"] for s in row["route"]] == [f"R{i:02d}" for i in range(1, 50, 2)] and row["stage"] == 1
