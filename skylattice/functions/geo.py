"""Great-circle geometry as SQL expressions over column names, in nautical miles and degrees.

Expressions use only functions and double literals that Spark and other engines share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, and metres in a nautical mile.
RADIUS_M, METRES_PER_NM = 6_371_000.0, 1852.0
_RADIUS_NM = "(6371000e0 / 1852e0)"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Distance in nautical miles. Latitude comes first."""
    dlat, dlon = f"radians({lat2} - {lat1}) / 2e0", f"radians({lon2} - {lon1}) / 2e0"
    h = f"(sin({dlat}) * sin({dlat}) + cos(radians({lat1})) * cos(radians({lat2})) * sin({dlon}) * sin({dlon}))"
    return f"(6371000e0 * 2e0 * atan2(sqrt({h}), sqrt(greatest(0e0, 1e0 - {h}))) / 1852e0)"


def normalised_sql(course: str) -> str:
    """A course in [0, 360)."""
    return f"((({course}) % 360e0 + 360e0) % 360e0)"


def course_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Initial true course from the first point to the second."""
    dlon = f"radians({lon2} - {lon1})"
    y = f"sin({dlon}) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({dlon})"
    return normalised_sql(f"degrees(atan2({y}, {x}))")


def arrival_course_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """True course on arrival at the second point."""
    return normalised_sql(f"{course_sql(lat2, lon2, lat1, lon1)} + 180e0")


def magnetic_sql(true_course: str, east: str) -> str:
    """Course less an easterly angle; null where the angle is."""
    return normalised_sql(f"{true_course} - {east}")


def haversine_nm(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))


#: Degrees added to a box on each side, so that rounding never leaves out a point.
PADDING = 1e-12


def bounds(lat: Column, lon: Column, radius_nm: Column) -> Column:
    """Boxes (array of south, north, west, east) that hold the circle around a point: one, or
    two where it crosses the antimeridian; all longitudes where it reaches a pole."""
    angle = radius_nm * METRES_PER_NM / RADIUS_M
    south, north = lat - F.degrees(angle) - PADDING, lat + F.degrees(angle) + PADDING
    polar = (south <= -90) | (north >= 90) | (angle >= 1.5707963267948966)
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-300))))) + PADDING
    west, east = lon - wide, lon + wide
    low, high = F.greatest(south, F.lit(-90.0)), F.least(north, F.lit(90.0))

    def box(a, b):
        return F.struct(low.alias("south"), high.alias("north"), a.alias("west"), b.alias("east"))

    full = F.array(box(F.lit(-180.0), F.lit(180.0)))
    return (
        F.when(polar | (wide >= 180), full)
        .when(west < -180, F.array(box(west + 360, F.lit(180.0)), box(F.lit(-180.0), east)))
        .when(east > 180, F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east - 360)))
        .otherwise(F.array(box(west, east)))
    )


def in_bounds(boxes: Column, lat: Column, lon: Column) -> Column:
    """Whether a point is in any of the boxes; edges count."""
    return F.exists(boxes, lambda b: lat.between(b["south"], b["north"]) & lon.between(b["west"], b["east"]))


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Number of the grid cell of a point; the last column of cells is that of +180."""
    columns = int(-(-360 // degrees)) + 1
    return (F.floor((lat + 90) / degrees) * columns + F.floor((lon + 180) / degrees)).cast("long")


def cells(boxes: Column, degrees: float) -> Column:
    """Numbers of all grid cells that the boxes touch."""
    columns = int(-(-360 // degrees)) + 1
    row = lambda x: F.floor((x + 90) / degrees).cast("long")
    column = lambda x: F.floor((x + 180) / degrees).cast("long")
    each = F.transform(
        boxes,
        lambda b: F.flatten(F.transform(F.sequence(row(b["south"]), row(b["north"])), lambda r: F.transform(F.sequence(column(b["west"]), column(b["east"])), lambda c: r * columns + c))),
    )
    return F.array_distinct(F.flatten(each))
