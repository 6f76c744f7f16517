"""Relations of the planner and payloads of the sources, as Spark schemas."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

VERSION = 1

# Navaid type numbers of the source, and the families they stand for.
FAMILY_BY_TYPE = {2: "NDB", 3: "VOR", 4: "VOR-DME", 5: "VORTAC", 6: "DVOR", 7: "DVOR-DME", 8: "DVORTAC"}
FAMILIES = tuple(FAMILY_BY_TYPE.values())
VOR_FAMILIES = FAMILIES[1:]
# Why a raw record isn't a planner navaid, in the order they are looked at.
REASONS = ("missing-stable-identity", "unsupported-navaid-type", "invalid-coordinates", "missing-identifier", "invalid-frequency", "invalid-published-range")
#: Range in NM of a record that gives none.
DEFAULT_RANGE_NM = 90.0


def fields(text: str) -> StructType:
    kinds = {"s": StringType(), "d": DoubleType(), "i": IntegerType(), "l": LongType(), "b": BooleanType(), "date": DateType(), "ss": ArrayType(StringType()), "is": ArrayType(IntegerType())}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


AIRPORTS = fields("database_id:s icao:s name:s longitude:d latitude:d magnetic_declination_deg_east:d")
NAVAIDS = fields(
    "database_id:s identifier:s name:s family:s longitude:d latitude:d frequency_value:d frequency_unit:s published_range_nm:d "
    "magnetic_declination_deg_east:d facility_variation_deg_east:d facility_variation_source:s facility_variation_effective_date:date"
)
#: Tables of a snapshot beside METADATA and AIRPORTS; planner navaids have their record's id too.
RAW = fields("source_record_id:s canonical_record:s checksum:s")
PLANNER = StructType([*fields("source_record_id:s"), *NAVAIDS])
EXCLUSIONS = fields("source_record_id:s reason:s")
AUDITS = fields("source_record_id:s outcome:s audit_record:s audit_checksum:s")
METADATA = fields("magnetic_model:s magnetic_model_version:s magnetic_model_epoch_year:d magnetic_reference_date:date magnetic_model_source:s")
REQUESTS = fields("request_id:s departure:s arrival:s")

POINT = StructType([StructField("type", StringType()), StructField("coordinates", ArrayType(DoubleType()))])
POLYGON = StructType([StructField("type", StringType()), StructField("coordinates", ArrayType(ArrayType(ArrayType(DoubleType()))))])
MEASURE = fields("value:d unit:i")
LIMIT = fields("value:d unit:i referenceDatum:i")
_COMMON = [StructField("_id", StringType()), StructField("name", StringType()), StructField("country", StringType()), StructField("updatedAt", StringType())]


def _entity(*more: StructField) -> StructType:
    return StructType([*_COMMON, *more])


def _f(name: str, kind) -> StructField:
    return StructField(name, kind)


#: Payload records by entity; unknown keys stay in the raw text beside them.
ENTITIES = {
    "navaid": _entity(_f("type", IntegerType()), _f("identifier", StringType()), _f("geometry", POINT), _f("frequency", fields("value:s unit:i")), _f("range", MEASURE), _f("channel", StringType()), _f("alignedTrueNorth", BooleanType()), _f("magneticDeclination", DoubleType()), _f("elevation", LIMIT)),
    "airport": _entity(
        _f("type", IntegerType()), _f("icaoCode", StringType()), _f("iataCode", StringType()), _f("geometry", POINT), _f("elevation", LIMIT), _f("trafficType", ArrayType(IntegerType())), _f("ppr", BooleanType()), _f("private", BooleanType()), _f("skydiveActivity", BooleanType()), _f("winchOnly", BooleanType()),
        _f("frequencies", ArrayType(fields("value:s unit:i type:i name:s primary:b publicUse:b"))),
        _f("runways", ArrayType(StructType([StructField("designator", StringType()), StructField("trueHeading", DoubleType()), StructField("mainRunway", BooleanType()), StructField("surface", StructType([StructField("composition", ArrayType(IntegerType())), StructField("condition", IntegerType())]))]))),
        _f("services", StructType([StructField("fuelTypes", ArrayType(IntegerType())), StructField("gliderTowing", ArrayType(IntegerType())), StructField("handlingFacilities", ArrayType(IntegerType())), StructField("passengerFacilities", ArrayType(IntegerType()))])),
    ),
    "airspace": _entity(_f("type", IntegerType()), _f("icaoClass", IntegerType()), _f("activity", IntegerType()), _f("geometry", POLYGON), _f("upperLimit", LIMIT), _f("lowerLimit", LIMIT), _f("onDemand", BooleanType()), _f("onRequest", BooleanType()), _f("byNotam", BooleanType())),
    "hotspot": _entity(_f("type", IntegerType()), _f("reliability", IntegerType()), _f("occurrence", IntegerType()), _f("geometry", POINT), *[_f(n, ArrayType(IntegerType())) for n in ("aircraftCategories", "timeOfDay", "favTimeOfDay", "favWindDirection", "reqWindDirection")]),
    "obstacle": _entity(_f("type", IntegerType()), _f("geometry", POINT), _f("elevation", LIMIT), _f("height", LIMIT), _f("osmTags", MapType(StringType(), StringType()))),
    "reporting-point": _entity(_f("compulsory", BooleanType()), _f("geometry", POINT), _f("airports", ArrayType(StringType()))),
}

#: Entities whose geometry is an area.
AREAS = ("airspace",)

#: Filters of each entity by the parameter's name: the field that equals a value or shares one.
FILTERS = {
    "navaid": {"type": "type", "alignedTrueNorth": "alignedTrueNorth"},
    "airport": {
        "type": "type", "trafficType": "trafficType", "ppr": "ppr", "private": "private", "skydiveActivity": "skydiveActivity", "winchOnly": "winchOnly", "servicesFuelType": "services.fuelTypes",
        "servicesGliderTowing": "services.gliderTowing", "servicesHandlingFacility": "services.handlingFacilities", "servicesPassengerFacility": "services.passengerFacilities",
    },
    "airspace": {n: n for n in ("type", "icaoClass", "activity", "onDemand", "onRequest", "byNotam")},
    "hotspot": {"category": "aircraftCategories"} | {n: n for n in ("type", "reliability", "occurrence", "timeOfDay", "favTimeOfDay", "favWindDirection", "reqWindDirection")},
    "obstacle": {"type": "type"},
    "reporting-point": {"airport": "airports"},
}

#: Versions of the stored tables, and how a version's tables become the next one's; a version
#: without a step is the newest.
MIGRATIONS: dict[int, tuple] = {}


def migration_steps(have: int, want: int = VERSION, steps: dict[int, tuple] | None = None) -> list:
    """Functions that take a version's tables to the wanted one, in order; steps has, for a
    version, the next version and the function. Cycles and versions without a way are errors."""
    steps, found, seen = MIGRATIONS if steps is None else steps, [], {have}
    while have != want:
        if have not in steps:
            raise ValueError(f"there is no way from version {have} to {want}")
        have, step = steps[have]
        if have in seen:
            raise ValueError(f"the steps from version {have} end in a circle")
        seen.add(have)
        found.append(step)
    return found
