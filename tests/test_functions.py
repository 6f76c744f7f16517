"""Functions against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.canonical import canonical_or_none
from skylattice.functions.geodesic import inverse_m
from skylattice.functions.magnetic import MagneticModel
from skylattice.functions.text import icao, megahertz_to_hertz, signed_variation
from skylattice.operators import facility


def test_distances_and_courses(spark):
    at = ("0e0", "0e0", "20e0", "10e0")
    row = spark.range(1).select(geo.haversine_nm(*at).alias("nm"), F.expr(geo.course_sql(*at)).alias("out"), F.expr(geo.arrival_course_sql(*at)).alias("arr"), geo.haversine_nm("20e0", "10e0", "35e0", "30e0").alias("next"), geo.haversine_nm("0e0", "179e0", "0e0", "-179e0").alias("over")).first()
    assert row["nm"] == pytest.approx(1337.025599687342, rel=1e-12) and row["next"] == pytest.approx(1389.7144458138014, rel=1e-12)
    assert row["out"] == pytest.approx(25.505550260982545, rel=1e-12) and row["arr"] == pytest.approx(27.273169556803623, rel=1e-12)
    assert row["over"] == pytest.approx(2 * 111194.92664455874 / 1852, rel=1e-12)


def test_ellipsoid_distance():
    assert inverse_m(0, 0, 0.01674892271018241, 0) == pytest.approx(1852, abs=1e-6)
    assert inverse_m(0, 0, 0.01674892271018241 + 1e-6, 0) > 1852
    assert inverse_m(10, 20, 10, 20) == 0 and np.isinf(inverse_m(0, 0, 0.1, 179.99))
    assert inverse_m(5, 179.9, 5, -179.9) == pytest.approx(inverse_m(5, 0, 5, 0.2), rel=1e-9)


def test_magnetic_model():
    axial = MagneticModel("axial", 2025, [(1, 0, -30000, 0, 0, 0)])
    assert axial.declination(2026, [10, -40], [5, 100]) == pytest.approx([0, 0], abs=1e-9)
    assert np.isnan(axial.declination(2026, 90, 0))
    tilted = MagneticModel("tilted", 2025, [(1, 0, -30000, 0, 0, 0), (1, 1, 0, 5000, 0, 100)])
    early, late = tilted.declination([2025, 2029], 0, 0)
    assert early == pytest.approx(np.degrees(np.arctan2(-5000, 30000))) and late < early
    with pytest.raises(ValueError):
        axial.declination(2030, 0, 0)


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ('{"b": 1.0, "a": [1e21, 1e-7, 0.000001, -0.0]}', '{"a":[1e+21,1e-7,0.000001,0],"b":1}'),
        ('{"\\u20ac": "\\u000f\\n", "1": true}', '{"1":true,"€":"\\u000f\\n"}'),
        ("333333333.33333329", "333333333.3333333"),
        ('{"a": 1, "a": 2}', None),
        ("NaN", None),
        ('"\\ud800"', None),
        ("{", None),
        (None, None),
    ],
)
def test_canonical_json(text, canonical):
    assert canonical_or_none(text) == canonical


def test_text_functions(spark):
    rows = [(" kjfk ", "112.3", "4.5", "w", "2020"), ("KJF", "0.0", "190", "E", "2020"), (None, "112.1234567", "180", "E", "0000"), ("K1FK", " 117.95 ", "180", "W", "2015")]
    df = spark.createDataFrame(rows, "code string, mhz string, m string, h string, y string")
    got = df.select(icao(F.col("code")), megahertz_to_hertz(F.col("mhz")), signed_variation(F.col("m"), F.col("h"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [("KJFK", 112_300_000, -4.5), (None, None, None), (None, None, None), (None, 117_950_000, -180.0)]


def test_facilities_by_brute_force(spark):
    """The pairs that are compared hold every pair within the bound: all over the globe, at the
    poles and the antimeridian, with one identifier and frequency for all."""
    rng = np.random.default_rng(6)
    n = 300
    lat = np.concatenate([rng.uniform(-90, 90, n), [90, -90, 89.999, 0, 0, 0.016748922, 60]])
    lon = np.concatenate([rng.uniform(-180, 180, n), [0, 10, 77, 180, -180, 0, 179.995]])
    turn, off = rng.uniform(0, 2 * np.pi, len(lat)), rng.choice([0.002, 0.0164, 0.0168, 0.03], len(lat))
    rlat = np.clip(lat + off * np.cos(turn), -90, 90)
    rlon = (lon + off * np.sin(turn) / np.maximum(np.cos(np.radians(lat)), 1e-6) + 180) % 360 - 180
    navaids = spark.createDataFrame([(str(i), "A", float(a), float(b), 112.3) for i, (a, b) in enumerate(zip(lat, lon))], "source_record_id string, identifier string, latitude double, longitude double, frequency_value double")
    records = spark.createDataFrame([(str(i), "A", float(a), float(b), 112_300_000) for i, (a, b) in enumerate(zip(rlat, rlon))], "record_id string, ident string, ref_latitude double, ref_longitude double, hz long")
    got = {(int(r["source_record_id"]), int(r["record_id"])) for r in facility.compared(navaids, records).collect()}
    i, j = np.meshgrid(np.arange(len(lat)), np.arange(len(lat)), indexing="ij")
    metres = inverse_m(lat[i], lon[i], rlat[j], rlon[j])
    want = set(zip(*(x.tolist() for x in np.nonzero(metres <= facility.NEAR_M + facility.ERROR_M))))
    assert want <= got and len(want) > 120 and len(got) < 2 * len(want)
    assert all(metres[k] <= 1.02 * (facility.NEAR_M + facility.ERROR_M) for k in got)
