"""Legs of planned routes: distances, courses, guidance and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import geo

# Warning codes in the order in which a plan reports them.
WARNINGS = ("ndb-fallback-used", "magnetic-course-unavailable", "vor-guidance-unavailable", "facility-variation-date-unavailable")


def route_points(plans: DataFrame, navaids: DataFrame) -> DataFrame:
    """Points of found routes by position: departure, navaids, arrival."""
    found = plans.filter("status = 'found'")
    nothing = {k: F.lit(None).cast(t).alias(k) for k, t in (("family", "string"), ("frequency_value", "double"), ("frequency_unit", "string"), ("published_range_nm", "double"), ("facility_variation_deg_east", "double"), ("facility_variation_source", "string"), ("facility_variation_effective_date", "date"))}
    ends = [
        found.select("request_id", position.alias("position"), F.lit("airport").alias("kind"), F.col(f"{end}_icao").alias("identifier"), *[F.col(f"{end}_airport.{c}").alias(c) for c in ("database_id", "name", "latitude", "longitude", "magnetic_declination_deg_east")], *nothing.values())
        for end, position in (("departure", F.lit(0)), ("arrival", F.col("legs")))
    ]
    over = found.select("request_id", F.posexplode("route").alias("position", "stop")).select("request_id", (F.col("position") + 1).alias("position"), F.col("stop.database_id").alias("database_id"))
    stops = over.join(navaids, "database_id").withColumn("kind", F.when(F.col("family") == "NDB", "ndb").otherwise("vor-family"))
    columns = ends[0].columns
    return ends[0].unionByName(ends[1]).unionByName(stops.select(columns))


def route_legs(plans: DataFrame, navaids: DataFrame) -> DataFrame:
    """Legs with departure_ and arrival_ points; courses at both ends, true and magnetic, and the
    course that a VOR there shows (null without a variation of record)."""
    points = route_points(plans, navaids)
    about = [c for c in points.columns if c not in ("request_id", "position")]
    w = Window.partitionBy("request_id").orderBy("position")
    pairs = points.withColumn("next", F.lead(F.struct(*about)).over(w)).filter("next is not null")
    legs = pairs.select("request_id", (F.col("position") + 1).alias("leg"), F.struct(*about).alias("departure"), F.col("next").alias("arrival"))
    at = ("departure.latitude", "departure.longitude", "arrival.latitude", "arrival.longitude")
    legs = legs.withColumn("distance_nm", geo.haversine_nm(*at)).withColumn("departure_true", F.expr(geo.course_sql(*at))).withColumn("arrival_true", F.expr(geo.arrival_course_sql(*at)))
    for end in ("departure", "arrival"):
        legs = legs.withColumn(f"{end}_magnetic", F.expr(geo.magnetic_sql(f"{end}_true", f"{end}.magnetic_declination_deg_east")))
        legs = legs.withColumn(f"{end}_guidance", F.when(F.col(f"{end}.kind") == "vor-family", F.expr(geo.magnetic_sql(f"{end}_true", f"{end}.facility_variation_deg_east"))))
    return legs


def warnings(legs: DataFrame, plans: DataFrame) -> DataFrame:
    """request_id, rank, code, leg and endpoint; by rank: the rule, then leg, then endpoint."""
    rows = []
    for e, end in enumerate(("departure", "arrival")):
        vor = F.col(f"{end}.kind") == "vor-family"
        rules = F.array(
            F.when(F.col(f"{end}_magnetic").isNull(), 1),
            F.when(vor & F.col(f"{end}_guidance").isNull(), 2),
            F.when(vor & F.col(f"{end}.facility_variation_deg_east").isNotNull() & F.col(f"{end}.facility_variation_effective_date").isNull(), 3),
        )
        rows.append(legs.select("request_id", F.explode(F.array_compact(rules)).alias("rule"), "leg", F.lit(e).alias("e"), F.lit(end).alias("endpoint")))
    fallback = plans.filter("mode = 'ndb-fallback'").select("request_id", F.lit(0).alias("rule"), F.lit(None).cast("int").alias("leg"), F.lit(0).alias("e"), F.lit(None).cast("string").alias("endpoint"))
    every = rows[0].unionByName(rows[1]).unionByName(fallback)
    code = F.array(*map(F.lit, WARNINGS))[F.col("rule")]
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("rule", "leg", "e"))
    return every.select("request_id", rank.alias("rank"), code.alias("code"), "leg", "endpoint")


def warning_summary(found: DataFrame) -> DataFrame:
    """Warnings of each request by code: how many, and where, as leg and endpoint in order."""
    place = F.struct("rank", F.concat_ws(" ", F.col("leg").cast("string"), "endpoint").alias("at"))
    return found.groupBy("request_id", "code").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(place)), lambda x: x["at"]).alias("places"))
