"""Pages and cycles, publication, and the contract."""

import json
import math
import random
import zipfile

import pytest

from pyspark.sql import functions as F

from frames import snapshot_frames
from skylattice.operators import classify, contract, snapshot
from skylattice.producer_queries import TIMES
from skylattice.schema import AIRPORTS, METADATA, NAVAIDS
from skylattice.sources import cycles, pages


def _page(n, total, ids, limit=2, **more):
    body = {"page": n, "limit": limit, "totalCount": total, "totalPages": -(-total // limit), "items": [{"_id": i, "name": f"Name {i}", "country": "US", "geometry": {"type": "Point", "coordinates": [float(n), 10.0]}} for i in ids]}
    if n < body["totalPages"]:
        body["nextPage"] = n + 1
    return json.dumps(body | more)


def _read(spark, tmp_path, *bodies):
    for i, b in enumerate(bodies):
        (tmp_path / f"{i}.json").write_text(b)
    return pages.envelopes(pages.read_pages(spark, str(tmp_path)))


def test_pages(spark, tmp_path):
    parsed = _read(spark, tmp_path, _page(1, 3, ["a", "b"]), _page(2, 3, ["c"]))
    assert not any(v for v in pages.drift(parsed).first())
    found = pages.typed(pages.records(parsed), "navaid")
    assert found.count() == 3 and pages.selected(found, "navaid", search="name C").count() == 1 and pages.selected(found, "navaid", country="CA").count() == 0
    assert pages.selected(found, "navaid", box=(0.0, 0.0, 1.5, 20.0)).count() == 2 and pages.selected(found, "navaid", within=(10.0, 2.0, 5000.0)).count() == 1


@pytest.mark.parametrize(
    ("flag", "bodies"),
    [
        ("invalid_page", ["{", _page(1, 1, ["a"])]),
        ("invalid_page", [_page(1, 1, ["a"], extra=1)]),
        ("totals_differ", [_page(1, 3, ["a", "b"]), _page(2, 4, ["c", "d"])]),
        ("pages_missing", [_page(1, 3, ["a", "b"])]),
        ("wrong_size", [_page(1, 3, ["a"]), _page(2, 3, ["c"])]),
        ("wrong_next", [_page(1, 1, ["a"], nextPage=2)]),
        ("ids_fall", [_page(1, 3, ["a", "c"]), _page(2, 3, ["b"])]),
    ],
)
def test_drift(spark, tmp_path, flag, bodies):
    assert pages.drift(_read(spark, tmp_path, *bodies)).first()[flag]


def test_names_are_searched_as_they_are(spark, tmp_path):
    found = pages.typed(pages.records(_read(spark, tmp_path, _page(1, 2, ["a%", "a_b"]))), "navaid")
    ids = lambda **how: sorted(r["_id"] for r in pages.selected(found, "navaid", fields=["_id"], **how).collect())
    assert ids(search="%", anywhere=True) == ["a%"] and ids(search="name a") == ["a%", "a_b"] and ids(search="A_", anywhere=True) == ["a_b"] and ids(ids=["a%"]) == ["a%"]


def test_attempts(spark, tmp_path):
    parsed = _read(spark, tmp_path, _page(1, 3, ["a", "b"]), _page(1, 3, ["a", "b"]), _page(2, 3, ["c"]))
    numbered = parsed.withColumn("attempt", F.when(F.col("file") == "0.json", 1).otherwise(2))
    assert pages.stable_attempt(pages.drift(numbered, "attempt")) == 2
    with pytest.raises(ValueError, match="changed"):
        pages.stable_attempt(pages.drift(numbered.filter("attempt = 1"), "attempt"))


@pytest.mark.parametrize("body", ["A,B\n1,2,3\n2,3\n", "A,B\n1\n", "A,A\n1,2\n", "B,A\n1,2\n", "", 'A,B\n"x,1\n'])
def test_other_tables_are_refused(body):
    with pytest.raises((ValueError, cycles.csv.Error)):
        cycles.table_rows(body, ["A", "A"] if "A,A" in body else ["A", "B"])


def test_cycle_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(cycles.MEMBER, 'A,B\r\n"1, ""x""",\r\n2,y\r\n')
    assert [tuple(r) for r in cycles.read_cycle(spark, str(tmp_path / "a.zip"), ["A", "B"]).collect()] == [('1, "x"', ""), ("2", "y")]
    (tmp_path / "a.csv").write_text('A,B\n"1\n""x""",\n2,y\n')
    assert [tuple(r) for r in cycles.read_csv(spark, str(tmp_path / "a.csv"), ["A", "B"]).collect()] == [('1\n"x"', ""), ("2", "y")]
    with pytest.raises(Exception, match="unexpected header"):
        cycles.read_cycle(spark, str(tmp_path / "a.zip"), ["A"]).collect()


def test_records_are_classified_by_the_first_reason(spark):
    good = {"_id": "x", "type": 3, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "identifier": "ABC", "frequency": {"value": "112.300", "unit": 2}}
    faults = [{}, {"type": 1}, {"geometry": {"type": "Point", "coordinates": [1.0, 91.0]}}, {"identifier": " "}, {"frequency": {"value": "112.30", "unit": 2}}, {"range": None}]
    rows = [(json.dumps(good | f | {"_id": str(i)}),) for i, f in enumerate(faults)]
    found = {r["source_record_id"]: r["reason"] for r in classify.classified(classify.identified(spark.createDataFrame(rows, "record string"))).collect()}
    assert [found[str(i)] for i in range(6)] == [None, "unsupported-navaid-type", "invalid-coordinates", "missing-identifier", "invalid-frequency", "invalid-published-range"]


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert snapshot.active_id(spark, root) is None and snapshot.status(spark, root) is None
    first = snapshot.publish(spark, root, snapshot_frames(spark, "ab", "a", "b"), provenance=TIMES)
    assert snapshot.active_id(spark, root) == first and snapshot.status(spark, root)["reconciles"]
    with pytest.raises(snapshot.SnapshotError, match="as it was"):
        snapshot.publish(spark, root, snapshot_frames(spark, "abc", "a", "b"), provenance=TIMES)
    assert snapshot.active_id(spark, root) == first
    second = snapshot.publish(spark, root, snapshot_frames(spark, "c", "c", ""), provenance=TIMES)
    assert snapshot.active_id(spark, root) == second and snapshot.read_active(spark, root)["raw_navaids"].count() == 1
    with pytest.raises(snapshot.SnapshotError):
        snapshot.remove(spark, root, second)


def test_contract(spark):
    airports = spark.createDataFrame([("1", "AAAA", "A", 0.0, 0.0, None)], AIRPORTS)
    navaids = spark.createDataFrame([("1", "N", "N", "NDB", 0.0, 0.0, 300.0, "kHz", 50.0, None, None, None, None)], NAVAIDS)
    metadata = spark.createDataFrame([(None,) * 5], METADATA)
    assert contract.contract_violations(airports, navaids, metadata) == []
    assert len(contract.contract_violations(airports.drop("name"), navaids, metadata)) == 1
    assert contract.contract_violations(airports.unionByName(airports), navaids, metadata) == ["planner_airports contains duplicate planner-ready identity data"]
    bad = navaids.withColumn("frequency_unit", navaids["name"])
    assert contract.contract_violations(airports, bad, metadata) == ["planner_navaids contains invalid planner-ready navigation data"]


def test_areas_by_brute_force(spark):
    """Random polygons, some with a hole, some across the antimeridian, against dense points on
    them: no box or circle that holds such a point may be missed, none far from all be found."""
    rng = random.Random(5)
    shapes = []
    for i in range(60):
        x, y, n = rng.uniform(-180, 180), rng.uniform(-60, 60), rng.randint(3, 8)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(x + 6 * math.cos(t), y + 6 * math.sin(t)) for t in turns]
        rings = [ring, [(x + (a - x) / 3, y + (b - y) / 3) for a, b in ring]] if i % 3 == 0 else [ring]
        shapes.append(rings)
    wrap = lambda v: (v + 180) % 360 - 180
    rows = [(json.dumps({"_id": str(i), "geometry": {"type": "Polygon", "coordinates": [[[wrap(a), b] for a, b in r] for r in rings]}}),) for i, rings in enumerate(shapes)]
    typed = pages.typed(spark.createDataFrame([*rows, ('{"_id": "none"}',)], "record string"), "airspace").cache()

    def inside(rings, x, y):
        crossings = 0
        for r in rings:
            for (a, b), (c, e) in zip(r, r[1:] + r[:1]):
                crossings += (b > y) != (e > y) and x < (c - a) * (y - b) / (e - b) + a
        return crossings % 2 == 1

    def dense(rings):
        out = [(a + (c - a) * t / 60, b + (e - b) * t / 60) for r in rings for (a, b), (c, e) in zip(r, r[1:] + r[:1]) for t in range(60)]
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        grid = [(min(xs) + (max(xs) - min(xs)) * i / 25, min(ys) + (max(ys) - min(ys)) * j / 25) for i in range(26) for j in range(26)]
        return out + [p for p in grid if inside(rings, *p)]

    points = [dense(r) for r in shapes]
    for west, south, east, north in ((-30.0, -20.0, 40.0, 30.0), (160.0, -50.0, -150.0, 50.0), (10.0, 10.0, 11.0, 11.0), (-180.0, -90.0, 180.0, 90.0)):
        got = {r["r"]["_id"] for r in pages.selected(typed, "airspace", box=(west, south, east, north)).collect()}
        span = (east - west) % 360 or 360
        near = lambda x, y, m: ((wrap(x) - west + m) % 360 <= span + 2 * m or span + 2 * m >= 360) and south - m <= y <= north + m
        for i, own in enumerate(points):
            assert (str(i) in got) or not any(near(x, y, 0.0) for x, y in own)
            assert (str(i) not in got) or any(near(x, y, 0.6) for x, y in own)

    def nm(a, b, c, e):
        p, q = math.radians(b), math.radians(e)
        h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a - c) / 2) ** 2
        return 2 * 6371000 / 1852 * math.asin(math.sqrt(min(1, h)))

    for lat, lon, metres in ((0.0, 0.0, 3e6), (10.0, 179.0, 2e6), (50.0, -100.0, 1e6), (-40.0, 20.0, 2e5)):
        got = {r["r"]["_id"] for r in pages.selected(typed, "airspace", within=(lat, lon, metres)).collect()}
        for i, own in enumerate(points):
            least = min(nm(x, y, lon, lat) for x, y in own) * 1852
            assert (str(i) in got) or least > metres * 0.995 - 2000
            assert (str(i) not in got) or least < metres * 1.005 + 60_000
