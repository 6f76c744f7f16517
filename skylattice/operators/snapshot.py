"""Immutable snapshots: each is a set of Parquet tables in a folder of its own; a pointer file,
renamed into place, says which is active. Readers resolve the pointer once."""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.integrity import COMPONENTS, LEFT_OUT, audit_counts, candidate_faults, checksum_parts, row_text, snapshot_checksum, told_checksum
from skylattice.schema import VERSION, fields
from skylattice.tables import together

TABLES = ("raw_navaids", "planner_navaids", "exclusions", "audits", "planner_airports", "metadata", "snapshots")
#: Steps of a publication, in order; the pointer is swapped in "activate".
BOUNDARIES = ("write", "describe", "read-back", "reconcile", "activate", "retire")
#: Checksums, counts and provenance of a snapshot, one row.
SNAPSHOTS = fields(
    "snapshot_id:s snapshot_checksum:s raw_navaids_checksum:s planner_navaids_checksum:s exclusions_checksum:s audits_checksum:s retrieved_at:s completed_at:s published_at:s source_identity:s "
    "derivation_policy:s matching_policy:s reference_url:s reference_retrieved_at:s archive_identity:s archive_checksum:s content_checksum:s cycle_id:s effective_date:s "
    "raw_count:l planner_count:l exclusion_count:l magnetic_model:s magnetic_model_version:s magnetic_model_epoch_year:d magnetic_reference_date:s magnetic_model_source:s magnetic_model_checksum:s"
)


#: Counts of SNAPSHOTS and the tables they are of.
COUNTED = {"raw_count": "raw_navaids", "planner_count": "planner_navaids", "exclusion_count": "exclusions"}


class SnapshotError(RuntimeError):
    """Publication failed; the message says whether the active snapshot is as it was. faults has
    the rules that a candidate broke, with their numbers."""

    def __init__(self, message: str, faults: list[tuple[str, int]] | None = None):
        super().__init__(message)
        self.faults = faults or []


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at, jvm.org.apache.hadoop.fs.Path


def active_id(spark: SparkSession, root: str) -> str | None:
    """The active snapshot; None where nothing was published. Never writes."""
    files, pointer, _ = _files(spark, f"{root}/active")
    return spark.read.text(f"{root}/active").first()[0] if files.exists(pointer) else None


def read_active(spark: SparkSession, root: str, snapshot: str | None = None) -> dict[str, DataFrame]:
    """Tables of the active (or a given) snapshot."""
    own = snapshot or active_id(spark, root)
    if own is None:
        raise SnapshotError("no snapshot is active")
    return {t: spark.read.parquet(f"{root}/{t}/snapshot_id={own}") for t in TABLES if _files(spark, f"{root}/{t}/snapshot_id={own}")[0].exists(_files(spark, f"{root}/{t}/snapshot_id={own}")[1])}


def active_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Each table of the root, all snapshots as partitions of it, joined with the pointer: which
    partition is read is found out when a query runs, so views over these follow the pointer."""
    files, at, _ = _files(spark, root)
    have = {s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()}
    pointer = spark.read.text(f"{root}/active").select(F.col("value").alias("snapshot_id")).filter("length(snapshot_id) > 0")
    out = {}
    for name in (t for t in TABLES if t in have):
        table = spark.read.parquet(f"{root}/{name}")
        kinds = {f.name: f.dataType for f in table.schema}
        table = table.withColumn("snapshot_id", F.col("snapshot_id").cast("string")) if kinds["snapshot_id"].typeName() != "string" else table
        out[name] = table.join(F.broadcast(pointer), "snapshot_id")
    return out


def register_views(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """A hash of the tables' names, columns and types, with the version of the schema."""
    told = {"version": VERSION, "tables": {n: [[f.name, f.dataType.simpleString()] for f in df.schema] for n, df in tables.items()}}
    return "sha256:" + hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The tables' columns: relation, place (from 1), name, type, and how many rows have a value."""
    found = []
    for n, df in sorted(tables.items()):
        one = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in df.schema])
        rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("filled")) for i, f in enumerate(df.schema, 1)])
        found.append(one.select(F.lit(n).alias("relation"), F.inline(rows)))
    return functools.reduce(DataFrame.unionByName, found)


def snapshot_row(spark: SparkSession, own: str, components: dict[str, dict], provenance: dict) -> DataFrame:
    """The row of SNAPSHOTS for tables of these checksums and counts, the rest from provenance
    (null where it says nothing)."""
    row = {f.name: provenance.get(f.name) for f in SNAPSHOTS} | {"snapshot_id": own, "snapshot_checksum": snapshot_checksum(components, provenance)}
    row |= {f"{k}_checksum": v["checksum"] for k, v in components.items()}
    row |= {c: components[t]["n"] for c, t in COUNTED.items() if t in components}
    return spark.createDataFrame([tuple(row[f.name] for f in SNAPSHOTS)], SNAPSHOTS)


def observed_write(df: DataFrame, path: str) -> dict:
    """Writes a table; its count and checksum are gathered in the same pass, from the rows as they
    come from the source."""
    seen = Observation()
    df.observe(seen, *checksum_parts(row_text(df, *LEFT_OUT))).write.parquet(path)
    return told_checksum(seen.get)


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], snapshot: str | None = None, provenance: dict | None = None, retire: bool = False, at: Callable[[str], None] = lambda boundary: None,
    declination=None, year: float | None = None,
) -> str:
    """Writes the tables and their row of SNAPSHOTS, reads them back and reconciles them, then
    swaps the pointer; ``retire`` deletes the snapshot that was active.

    Counts and checksums of the source's rows are gathered while they are written; what is read
    back must have the same, and pass all rules of candidate_faults (with ``declination``, a
    function of year, latitude and longitude, those of the model too). A failure before the swap
    deletes what was written and leaves the active snapshot as it was; one after it leaves the new
    one active. Its error says which, and at which of BOUNDARIES. ``at`` is called at each of
    them."""
    own, before, boundary, provenance = snapshot or str(uuid.uuid4()), active_id(spark, root), BOUNDARIES[0], provenance or {}
    try:
        at(boundary)
        seen = dict(zip(tables, together(*[functools.partial(observed_write, df, f"{root}/{name}/snapshot_id={own}") for name, df in tables.items()])))
        boundary = "describe"
        at(boundary)
        snapshot_row(spark, own, {k: seen[k] for k in COMPONENTS if k in seen}, provenance).write.parquet(f"{root}/snapshots/snapshot_id={own}")
        boundary = "read-back"
        at(boundary)
        written = read_active(spark, root, own)
        if fingerprint({n: written[n] for n in tables}) != fingerprint(tables):
            raise SnapshotError("the tables written have other columns")
        boundary = "reconcile"
        at(boundary)
        stored = written["snapshots"].first().asDict()
        described = {k: {"n": seen[k]["n"], "checksum": stored[f"{k}_checksum"]} for k in COMPONENTS if k in seen}
        wrong = candidate_faults(written, described, stored["snapshot_checksum"], provenance, declination, year)
        wrong += [(f"the snapshot's {c} isn't that of its table", 1) for c, t in COUNTED.items() if t in seen and stored[c] != seen[t]["n"]]
        if wrong:
            raise SnapshotError("; ".join(f"{text} ({n})" for text, n in wrong), wrong)
        boundary = "activate"
        at(boundary)
        activate(spark, root, own)
        boundary = "retire"
        at(boundary)
        if retire and before is not None:
            remove(spark, root, before)
    except Exception as e:
        if active_id(spark, root) == own:
            raise SnapshotError(f"{boundary}: {e}; the new snapshot is active") from e
        remove(spark, root, own)
        raise SnapshotError(f"{boundary}: {e}; the active snapshot is as it was", getattr(e, "faults", None)) from e
    return own


def state(spark: SparkSession, root: str) -> DataFrame:
    """One row: active_id, and the row of SNAPSHOTS of it; nulls where nothing is active."""
    own = active_id(spark, root)
    pointer = spark.createDataFrame([(own,)], "active_id string")
    known = spark.createDataFrame([], SNAPSHOTS) if own is None else read_active(spark, root, own)["snapshots"]
    return pointer.join(known, F.col("active_id") == F.col("snapshot_id"), "left")


def activate(spark: SparkSession, root: str, snapshot: str) -> None:
    """The pointer's new content is written aside and renamed over it."""
    files, pointer, path = _files(spark, f"{root}/active")
    aside = path(f"{root}/.active-{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray((snapshot + "\n").encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = overwrite
    context.rename(aside, pointer, array)


def remove(spark: SparkSession, root: str, snapshot: str) -> None:
    if active_id(spark, root) == snapshot:
        raise SnapshotError("the active snapshot can't be removed")
    for t in TABLES:
        files, at, _ = _files(spark, f"{root}/{t}/snapshot_id={snapshot}")
        files.delete(at, True)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a parent, counted."""
    return children.join(parents.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def status(spark: SparkSession, root: str) -> dict | None:
    """Counts of the active snapshot, in one pass of each table; None where there is none."""
    own = active_id(spark, root)
    if own is None:
        return None
    t = read_active(spark, root, own)
    navaids = t["planner_navaids"].agg(F.count(F.lit(1)).alias("planner"), F.count_if(F.col("family") != "NDB").alias("vor_family"), F.count_if(F.col("family") == "NDB").alias("fallback")).first().asDict()
    out = {"snapshot_id": own, "raw": t["raw_navaids"].count(), **navaids}
    out["exclusions"] = {r["reason"]: r["n"] for r in t["exclusions"].groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    if "audits" in t:
        if "audit_record" in t["audits"].columns:
            out |= audit_counts(t["audits"]).first().asDict()
        out["outcomes"] = {r["outcome"]: r["n"] for r in t["audits"].groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    if "planner_airports" in t:
        out["airports"] = t["planner_airports"].count()
    out["reconciles"] = out["planner"] + sum(out["exclusions"].values()) == out["raw"]
    return out
