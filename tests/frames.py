"""Small tables that several tests use."""

import json

from skylattice.functions.canonical import canonical_text
from skylattice.operators.classify import identified
from skylattice.operators.facility import audit_text
from skylattice.schema import EXCLUSIONS, PLANNER


def snapshot_frames(spark, raw: str, planner: str, excluded: str) -> dict:
    """A sound snapshot's tables (where the letters are): records, VORs, exclusions, audits."""
    records = [(canonical_text({"_id": i, "note": json.dumps(i)}),) for i in raw]
    navaids = [(i, f"id:{i}", i.upper(), f"Navaid {i}", "VOR", 10.0, 50.0, 112.3, "MHz", 40.0, None, None, None, None) for i in planner]
    audits = spark.createDataFrame([(i, "no-unique-match", None) for i in planner], "source_record_id string, outcome string, variation_year int")
    return {"raw_navaids": identified(spark.createDataFrame(records, "record string")).drop("has_own_id"), "planner_navaids": spark.createDataFrame(navaids, PLANNER), "exclusions": spark.createDataFrame([(i, "missing-identifier") for i in excluded], EXCLUSIONS), "audits": audit_text(audits)}
