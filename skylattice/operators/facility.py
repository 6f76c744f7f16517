"""Facility variation: the one reference record that is the same navaid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.geodesic import wgs84_m
from skylattice.functions.text import megahertz_to_hertz, sha256_tag, signed_variation, stripped

#: Farthest that two records of one facility stand apart, and the error of the distance, in m.
NEAR_M, ERROR_M = 1852.0, 0.001
#: Width in degrees of the cells in which navaids meet records; and how much farther two places can
#: be on the sphere than on the ellipsoid, with room to spare.
CELL, FAR = 0.1, 1.01
# Facility types of the reference table that can be matched.
TYPES = ("VOR", "VOR/DME", "VORTAC")
# What becomes of a match.
OUTCOMES = ("matched", "no-unique-match", "outside-source-coverage", "unusable-source-value")


def latest_cycle(cycles: DataFrame, started: str) -> DataFrame:
    """The cycle of the latest effective date that is in force and published by ``started``
    (ISO timestamp), with ``n``, how many share that date; more than one is an error."""
    usable = cycles.filter((F.col("effective_date") <= F.lit(started).cast("date")) & (F.col("published_at") <= F.lit(started).cast("timestamp")))
    return usable.groupBy("effective_date").agg(F.count(F.lit(1)).alias("n"), F.min("cycle_id").alias("cycle_id"), F.min("published_at").alias("published_at")).orderBy(F.desc("effective_date")).limit(1)


def reference_records(csv: DataFrame) -> DataFrame:
    """Usable records of the reference table (all columns text), typed, with their identity."""
    columns = sorted(csv.columns)
    present = lambda c: F.col(c) if c in csv.columns else F.lit(None).cast("string")
    lat, lon = stripped(present("LAT_DECIMAL")).try_cast("double"), stripped(present("LONG_DECIMAL")).try_cast("double")
    rows = csv.select(
        F.sha2(F.to_json(F.struct(*columns)), 256).alias("record_id"),
        F.upper(stripped(present("NAV_ID"))).alias("ident"),
        F.upper(stripped(present("NAV_TYPE"))).alias("facility_type"),
        F.when(lat.between(-90, 90), lat).alias("ref_latitude"),
        F.when(lon.between(-180, 180), lon).alias("ref_longitude"),
        megahertz_to_hertz(present("FREQ")).alias("hz"),
        signed_variation(present("MAG_VARN"), present("MAG_VARN_HEMIS"), present("MAG_VARN_YEAR")).alias("variation_deg_east"),
        stripped(present("MAG_VARN_YEAR")).try_cast("int").alias("variation_year"),
        F.coalesce(F.nullif(F.upper(stripped(present("COUNTRY_CODE"))), F.lit("")), F.lit("US")).alias("country_code"),
    )
    return rows.filter(F.col("facility_type").isin(*TYPES) & F.col("ref_latitude").isNotNull() & F.col("ref_longitude").isNotNull() & F.col("hz").isNotNull())


def _asked(navaids: DataFrame) -> DataFrame:
    hz = F.round(F.col("frequency_value") * 1_000_000).cast("long")
    return navaids.withColumn("ident", F.upper(stripped(F.col("identifier")))).withColumn("hz", hz)


def compared(navaids: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of a navaid and a record whose distance on the ellipsoid is worth taking: of the same
    identifier and exact frequency, met in a cell of CELL degrees, and no farther on the sphere
    than FAR times the bound. A record looks into the cells around it, a navaid stands in one; so
    pairs grow with the rows, however many share an identifier and a frequency."""
    reach = F.lit((NEAR_M + ERROR_M) / 1852 * FAR)
    box = geo.bounds(F.col("ref_latitude"), F.col("ref_longitude"), reach)
    spread = records.withColumn("cell", F.explode(geo.cells(box, CELL)))
    placed = _asked(navaids).withColumn("cell", geo.cell(F.col("latitude"), F.col("longitude"), CELL))
    met = placed.join(spread, ["ident", "hz", "cell"]).drop("cell").filter(F.abs(F.col("latitude") - F.col("ref_latitude")) * 60 <= reach)
    return met.filter(geo.haversine_nm("latitude", "longitude", "ref_latitude", "ref_longitude") <= reach)


def match_facilities(navaids: DataFrame, records: DataFrame, countries: DataFrame, source: str) -> DataFrame:
    """An audit row for each navaid (source_record_id, identifier, latitude, longitude,
    frequency_value, country array): outcome, and the matched record's columns.

    Outcomes, the first that holds: outside-source-coverage (it has countries, none in
    ``countries``), no-unique-match (not exactly one record of the same identifier and exact
    frequency within a nautical mile), unusable-source-value, matched.
    """
    near = compared(navaids, records).withColumn("metres", wgs84_m("latitude", "longitude", "ref_latitude", "ref_longitude")).filter(F.col("metres") <= NEAR_M + ERROR_M)
    asked = _asked(navaids)
    details = ("record_id", "facility_type", "ref_latitude", "ref_longitude", "variation_deg_east", "variation_year", "metres")
    found = near.groupBy("source_record_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*details)).alias("hit"))
    country = asked.select("source_record_id", F.explode("country").alias("code")).select("source_record_id", F.upper(stripped(F.col("code"))).alias("country_code"))
    covered = country.join(countries.select("country_code").distinct(), "country_code", "left_semi").select("source_record_id").distinct().withColumn("covered", F.lit(True))
    rows = asked.join(found, "source_record_id", "left").join(covered, "source_record_id", "left")
    outside = (F.size(F.coalesce("country", F.array().cast("array<string>"))) > 0) & F.col("covered").isNull()
    outcome = F.when(outside, "outside-source-coverage").when(F.coalesce("n", F.lit(0)) != 1, "no-unique-match").when(F.col("hit.variation_deg_east").isNull(), "unusable-source-value").otherwise("matched")
    rows = rows.withColumn("outcome", outcome)
    known, matched = F.col("outcome").isin("matched", "unusable-source-value"), F.col("outcome") == "matched"
    return rows.select(
        "source_record_id", "outcome", F.when(matched, F.lit(source)).alias("source_identity"),
        *[F.when(known, F.col(f"hit.{c}")).alias(c) for c in ("record_id", "facility_type", "ref_latitude", "ref_longitude")],
        F.when(matched, F.col("hit.variation_deg_east")).alias("facility_variation_deg_east"), F.when(matched, F.col("hit.variation_year")).alias("variation_year"),
        F.when(known, F.col("hit.metres") / 1852).alias("separation_nm"), "ident", "hz",
    )


def audit_text(audits: DataFrame) -> DataFrame:
    """Audits with their JSON and its checksum."""
    return audits.withColumn("audit_record", F.to_json(F.struct(*sorted(audits.columns)), {"ignoreNullFields": "false"})).withColumn("audit_checksum", sha256_tag(F.col("audit_record")))
