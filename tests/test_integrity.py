"""Checks of candidates and cycles, checksums, and publication at each boundary."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.canonical import canonical_text
from skylattice.functions.magnetic import MagneticModel, decimal_year, decimal_year_of
from skylattice.operators import classify, facility, integrity, projection, snapshot
from skylattice.plans.search import navigable_edges, schedule
from skylattice.producer_queries import DAY, DIPOLE, TIMES, _snapshot
from skylattice.schema import NAVAIDS, migration_steps
from frames import snapshot_frames


def test_checksum_of_a_set(spark):
    """The same whatever the partitions, and another for another set."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("t"))
    told = {integrity.set_checksum(x, F.col("t")).first()["checksum"] for x in (df, df.repartition(7), df.coalesce(1), df.orderBy(F.rand(3)))}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    told.add(integrity.set_checksum(df.repartition(3), F.col("t")).first()["checksum"])
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(told) == 1
    assert integrity.set_checksum(df.filter("t <> '7'"), F.col("t")).first()["checksum"] not in told and integrity.set_checksum(df.unionByName(df.limit(1)), F.col("t")).first()["checksum"] not in told


@pytest.fixture(scope="module")
def candidate(spark, sf_dir):
    tables = {k: v.cache() for k, v in _snapshot(spark, sf_dir).items()}
    provenance = TIMES | {"source_identity": "test"}
    components = integrity.component_checksums(tables)
    return tables, components, integrity.snapshot_checksum(components, provenance), provenance


def test_candidate(candidate):
    tables, components, checksum, provenance = candidate
    model = MagneticModel("dipole", 2025, DIPOLE).udf()
    check = lambda t=tables, c=components, s=checksum, p=provenance: integrity.candidate_violations(t, c, s, p, model, decimal_year_of(DAY))
    assert check() == []
    assert check(p=provenance | {"retrieved_at": "2025-01-01T00:01:00.000Z"}) == []  # not part of the checksum
    assert "the times" in check(p=provenance | {"completed_at": "2024-01-01T00:00:00.000Z"})[0]
    assert check(s="sha256:0") == ["the checksum of the snapshot differs"]
    p = tables["planner_navaids"]
    off = tables | {"planner_navaids": p.withColumn("magnetic_declination_deg_east", F.col("magnetic_declination_deg_east") + 1)}
    assert "declinations of planner navaids aren't the model's" in check(t=off)
    less = check(t=tables | {"planner_navaids": p.filter("source_record_id <> (select 'id2')")})
    assert "planner navaids and exclusions aren't the raw records" in less and "checksums of components differ" in less


def test_publication_fails_at_each_boundary(spark, tmp_path):
    root = f"file://{tmp_path}"
    tables = snapshot_frames(spark, "ab", "a", "b")
    first = snapshot.publish(spark, root, tables, provenance=TIMES | {"cycle_id": "2501"})
    assert snapshot.state(spark, root).first()["raw_count"] == 2 and snapshot.state(spark, root).first()["cycle_id"] == "2501"

    def fail(where):
        def at(boundary):
            if boundary == where:
                raise RuntimeError("stopped")

        return at

    for b in snapshot.BOUNDARIES[:-1]:
        with pytest.raises(snapshot.SnapshotError, match=f"{b}: stopped; the active snapshot is as it was"):
            snapshot.publish(spark, root, tables, snapshot=f"s-{b}", provenance=TIMES, at=fail(b))
        assert snapshot.active_id(spark, root) == first and not (tmp_path / "raw_navaids" / f"snapshot_id=s-{b}").exists()
    with pytest.raises(snapshot.SnapshotError, match="the new snapshot is active"):
        snapshot.publish(spark, root, tables, snapshot="new", provenance=TIMES, retire=True, at=fail("retire"))
    assert snapshot.active_id(spark, root) == "new" and snapshot.status(spark, root)["reconciles"]
    assert snapshot.state(spark, f"{root}/none").first()["active_id"] is None


BROKEN = {
    "audits is missing": lambda t: {k: v for k, v in t.items() if k != "audits"},
    "raw_navaids is missing required column checksum": lambda t: t | {"raw_navaids": t["raw_navaids"].drop("checksum")},
    "ids of raw records are missing or stand twice": lambda t: t | {"raw_navaids": t["raw_navaids"].unionByName(t["raw_navaids"])},
    "raw records aren't canonical or have other checksums": lambda t: t | {"raw_navaids": t["raw_navaids"].withColumn("canonical_record", F.concat("canonical_record", F.lit(" broken")))},
    "planner navaids aren't valid": lambda t: t | {"planner_navaids": t["planner_navaids"].withColumn("latitude", F.lit(123.0))},
    "ids of planner navaids stand twice": lambda t: t | {"planner_navaids": t["planner_navaids"].withColumn("database_id", F.lit("one"))},
    "planner navaids and exclusions aren't the raw records": lambda t: t | {"exclusions": t["exclusions"].limit(0)},
    "exclusions have unknown reasons": lambda t: t | {"exclusions": t["exclusions"].withColumn("reason", F.lit("because"))},
    "audits aren't those of the navaids of the VOR families": lambda t: t | {"audits": t["audits"].limit(0)},
    "audits have another text than their columns": lambda t: t | {"audits": t["audits"].withColumn("audit_checksum", F.lit("sha256:0"))},
    "audits don't agree with their navaids": lambda t: t | {"planner_navaids": t["planner_navaids"].withColumn("facility_variation_deg_east", F.lit(3.0)).withColumn("facility_variation_source", F.lit("x"))},
}


@pytest.mark.parametrize("rule", BROKEN)
def test_broken_candidates_are_refused(spark, tmp_path, rule):
    """One broken candidate for each rule; none is published, nothing of it stays."""
    root = f"file://{tmp_path}"
    with pytest.raises(snapshot.SnapshotError, match="as it was") as told:
        snapshot.publish(spark, root, BROKEN[rule](snapshot_frames(spark, "abc", "ab", "c")), snapshot="s", provenance=TIMES)
    assert rule in [text for text, _ in told.value.faults]
    assert snapshot.active_id(spark, root) is None and not list(tmp_path.glob("*/snapshot_id=s"))


def test_times_and_stored_checksums(spark, tmp_path):
    root, tables = f"file://{tmp_path}", snapshot_frames(spark, "abc", "ab", "c")
    for times, rule in (({}, "the times of retrieval are missing or aren't UTC times"), (TIMES | {"completed_at": "2024-01-01T00:00:00Z"}, "the times of retrieval don't follow each other"), (TIMES | {"reference_retrieved_at": "2025-01-01T01:00:00Z"}, "the reference table was retrieved at another time")):
        with pytest.raises(snapshot.SnapshotError) as told:
            snapshot.publish(spark, root, tables, provenance=times)
        assert rule in [text for text, _ in told.value.faults]

    def lose(boundary):
        if boundary == "read-back":
            tables["exclusions"].limit(0).write.mode("overwrite").parquet(f"{root}/exclusions/snapshot_id=s")

    with pytest.raises(snapshot.SnapshotError) as told:
        snapshot.publish(spark, root, tables, snapshot="s", provenance=TIMES, at=lose)
    assert {"counts of components differ", "checksums of components differ", "the checksum of the snapshot differs"} < {text for text, _ in told.value.faults}
    # what the source's rows give while they are written is what the table gives when it is read
    seen = snapshot.observed_write(tables["raw_navaids"].repartition(5), f"{root}/seen")
    assert seen == integrity.component_checksums({"t": spark.read.parquet(f"{root}/seen")})["t"] == integrity.component_checksums({"t": tables["raw_navaids"]})["t"]
    assert snapshot.observed_write(tables["raw_navaids"].limit(0), f"{root}/none")["n"] == 0


def test_views_follow_the_pointer(spark, tmp_path):
    """A view over all snapshots reads the active one's partition only, whichever it is by then."""
    root = f"file://{tmp_path}"
    first = snapshot.publish(spark, root, snapshot_frames(spark, "abc", "ab", "c"), provenance=TIMES)
    snapshot.publish(spark, root, snapshot_frames(spark, "abcd", "abcd", ""), provenance=TIMES)
    snapshot.register_views(spark, snapshot.active_tables(spark, root), "followed_")
    asked = spark.sql("SELECT source_record_id FROM followed_planner_navaids")
    assert "dynamicpruning" in asked._jdf.queryExecution().toString().lower()
    assert sorted(r[0] for r in asked.collect()) == list("abcd")
    snapshot.activate(spark, root, first)
    spark.catalog.refreshByPath(f"{root}/active")
    assert sorted(r[0] for r in spark.sql("SELECT source_record_id FROM followed_planner_navaids").collect()) == list("ab")
    assert spark.sql("SELECT count(*) FROM followed_snapshots").first()[0] == 1


def test_fingerprint_and_migrations(spark):
    a, b = spark.range(1), spark.range(1).select(F.col("id").cast("string").alias("id"))
    assert snapshot.fingerprint({"t": a}) == snapshot.fingerprint({"t": a.limit(0)}) != snapshot.fingerprint({"t": b})
    assert migration_steps(1) == [] and migration_steps(1, 3, {1: (2, "a"), 2: (3, "b")}) == ["a", "b"]
    for steps in ({}, {1: (2, "a")}, {1: (2, "a"), 2: (1, "b")}):
        with pytest.raises(ValueError):
            migration_steps(1, 3, steps)


def test_cycle(spark):
    records = spark.createDataFrame([("2025-01-23", "ABC", "VOR", "10", "20", "112.3")], "EFF_DATE string, NAV_ID string, NAV_TYPE string, LAT_DECIMAL string, LONG_DECIMAL string, FREQ string")
    good = {"source_url": "https://nfdc.faa.gov/webContent/28DaySub/x.zip", "cycle_id": "2501", "archive_identity": "x.zip", "effective_date": "2025-01-23", "published_at": "2024-12-26T00:00:00.000Z", "retrieved_at": "2025-01-02T00:00:00.000Z", "archive_checksum": "sha256:" + "0" * 64, "content_checksum": integrity.set_checksum(records, integrity.row_text(records)).first()["checksum"]}
    check = lambda r=records, **more: integrity.cycle_violations(good | more, r, good["archive_checksum"])
    assert check() == []
    for more in ({"source_url": "http://nfdc.faa.gov/webContent/28DaySub/x.zip"}, {"cycle_id": "25A1"}, {"archive_identity": "y.zip"}, {"published_at": "2024-12-26"}, {"archive_checksum": "sha256:" + "1" * 64}):
        assert len(check(**more)) == 1, more
    assert check(effective_date="2025-02-30")[0] == "the effective date isn't a date" and "records are of another date" in check(effective_date="2025-02-20")
    assert "the cycle has no records" in check(records.limit(0)) and "records have unusable content" in check(records.withColumn("FREQ", F.lit("0")))


def test_duplicate_ids_and_audits(spark):
    rows = classify.identified(spark.createDataFrame([(json.dumps({"_id": i, "n": n}),) for n, i in enumerate(["a", "a ", "b", None, None])] + [("{",)], "record string"))
    assert [r["source_record_id"] for r in classify.duplicate_ids(rows).collect()] == ["a"]
    audits = facility.audit_text(spark.createDataFrame([("x", "matched", None), ("y", "no-unique-match", 2)], "source_record_id string, outcome string, variation_year int"))
    assert audits.filter("source_record_id = 'x'").first()["audit_record"] == canonical_text({"outcome": "matched", "source_record_id": "x", "variation_year": None})
    assert integrity.audit_counts(audits).first().asDict() == {"audits": 2, "present": 1, "missing": 1, "year_missing": 1, "inconsistent": 0}


def test_generated_ids_of_one_content(spark):
    """One content in most rows: each gets a number of its own, over all partitions."""
    raw = spark.range(4000).select(F.when(F.col("id") % 8 > 0, '{"a": 1}').otherwise(F.format_string('{"a": %d}', F.col("id"))).alias("record")).repartition(9)
    ids = [r[0] for r in classify.identified(raw).select("source_record_id").collect()]
    assert len(ids) == len(set(ids)) == 4000
    hot = sorted(int(i.rpartition(":")[2]) for i in ids if ids.count(i) == 1 and i.rpartition(":")[0] in max([x.rpartition(":")[0] for x in ids], key=lambda k: sum(x.startswith(k) for x in ids[:50])))
    assert hot == list(range(1, 3501))


def test_pairs_by_brute_force(spark):
    """Ranges from 1 to 4,000 NM, places near the poles and the antimeridian."""
    rng = np.random.default_rng(2)
    n = 160
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    lat[:6], lon[6:12], lon[12:18] = 89.9, 179.99, -179.99
    reach = rng.choice([1, 30, 70, 300, 4000], n, p=[0.1, 0.3, 0.3, 0.25, 0.05])
    rows = [(f"{i:03d}", "n", "n", "VOR", float(lon[i]), float(lat[i]), 110.0, "MHz", float(reach[i]), None, None, None, None) for i in range(n)]
    got = {(r["a"], r["b"]): r["nm"] for r in navigable_edges(spark.createDataFrame(rows, NAVAIDS)).collect()}
    p, l = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((l[:, None] - l) / 2) ** 2
    nm = 2 * 6371000 / 1852 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0, 1 - h)))
    want = {(f"{i:03d}", f"{j:03d}"): nm[i, j] for i in range(n) for j in range(i + 1, n) if nm[i, j] <= reach[i] + reach[j]}
    assert set(got) == set(want) and len(want) > 300 and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_model_against_the_potential():
    """A model of degree 4 against numeric slopes of its potential, from explicit polynomials."""
    rng = np.random.default_rng(8)
    rows = [(n, m, rng.normal() * 9000 / n**3 - (30000 if (n, m) == (1, 0) else 0), rng.normal() * 9000 / n**3 * (m > 0), rng.normal(), rng.normal() * (m > 0)) for n in range(1, 5) for m in range(n + 1)]
    model = MagneticModel("made", 2025, rows)

    def schmidt(n, m, x):
        p = np.polynomial.polynomial.Polynomial([-1, 0, 1]) ** n
        for _ in range(n + m):
            p = p.deriv()
        from math import factorial

        scale = 1 / (2**n * factorial(n)) * (1 if m == 0 else np.sqrt(2 * factorial(n - m) / factorial(n + m)))
        return scale * (1 - x * x) ** (m / 2) * p(x)

    def potential(r, beta, lam, since):
        return sum(6371.2 * (6371.2 / r) ** (n + 1) * ((g + since * dg) * np.cos(m * lam) + (h + since * dh) * np.sin(m * lam)) * schmidt(n, m, np.sin(beta)) for n, m, g, h, dg, dh in rows)

    for lat, lon, year in ((50, 10, 2025.0), (-33.3, 151.2, 2026.5), (0, -70, 2029.9), (71, -179, 2027.25)):
        phi, lam, f = np.radians(lat), np.radians(lon), 1 / 298.257223563
        e2 = f * (2 - f)
        normal = 6378.137 / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        p, z = normal * np.cos(phi), normal * (1 - e2) * np.sin(phi)
        r, beta, s = np.hypot(p, z), np.arctan2(z, p), 1e-5
        v = lambda dr=0.0, db=0.0, dl=0.0: potential(r + dr, beta + db, lam + dl, year - 2025)
        north = -(v(db=s) - v(db=-s)) / (2 * s * r)
        east = -(v(dl=s) - v(dl=-s)) / (2 * s * r * np.cos(beta))
        down = (v(dr=s * r) - v(dr=-s * r)) / (2 * s * r)
        level = north * np.cos(beta - phi) - down * np.sin(beta - phi)
        assert model.declination(year, lat, lon) == pytest.approx(np.degrees(np.arctan2(east, level)), abs=1e-4)


def test_projection_and_schedule(spark):
    a = spark.createDataFrame([("1", "ABCD", "x", 10.0, 50.0), ("2", "ABCE", "y", 10.0, None)], "database_id string, icao string, name string, longitude double, latitude double")
    model = MagneticModel("dipole", 2025, DIPOLE)
    rows = {r["icao"]: r["magnetic_declination_deg_east"] for r in projection.planner_airports(a, model, dt.date(2025, 1, 1)).collect()}
    assert rows["ABCD"] == pytest.approx(float(model.declination(2025.0, 50.0, 10.0))) and rows["ABCE"] is None
    assert projection.planner_metadata(spark, model, DAY, "1", "made").first()["magnetic_model_epoch_year"] == 2025
    day = spark.createDataFrame([(dt.date(2028, 12, 31),)], "d date")
    assert day.select(decimal_year(F.col("d"))).first()[0] == decimal_year_of(dt.date(2028, 12, 31)) == 2028 + 365 / 366
    assert spark.range(1).select(F.lit(100.0).alias("direct_nm")).select(schedule(factor=1.2)).first()[0] == pytest.approx([110.0, 120.0])
    with pytest.raises(Exception, match="outside the domain"):
        projection.with_declination(a.withColumn("longitude", F.lit(180.0)), model, DAY).collect()


def test_faults_of_search_inputs(spark):
    c = spark.createDataFrame([("r", "a", "VOR", 1.0, 1.0, 1.0), ("r", "a", "VOR", 1.0, 1.0, 1.0), ("r", " ", "X", float("nan"), 1.0, 1.0), ("r", "b", "NDB", 1.0, -1.0, 1.0)], "request_id string, database_id string, family string, dep_nm double, arr_nm double, published_range_nm double")
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 1.0), ("b", "a", float("inf"))], "a string, b string, nm double")
    assert integrity.search_faults(c, e).first().asDict() == {"no_id": 1, "unknown_family": 1, "bad_distance": 2, "repeated": 1, "unordered_pairs": 1, "repeated_pairs": 1, "bad_pairs": 1}
