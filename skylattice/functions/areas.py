"""Areas (rings of longitude and latitude, the first outside, the others holes) against boxes and
points, as SQL over arrays. An area that crosses the antimeridian is taken with its western part
360 degrees on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.functions import geo

#: Radius of the sphere that distances are on, in NM.
RADIUS_NM = "(6371000e0 / 1852e0)"


def edges(rings: Column) -> Column:
    """Edges (x1, y1, x2, y2) of all rings; a ring that isn't closed is closed."""
    lon = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[0])))
    wide = F.array_max(lon) - F.array_min(lon) > 180
    x = lambda p: F.when(wide & (p[0] < 0), p[0] + 360).otherwise(p[0])

    def of(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda a, b: F.struct(x(a).alias("x1"), a[1].alias("y1"), x(b).alias("x2"), b[1].alias("y2")))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of))


def holds(found: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies within the edges (an odd number of them east of it)."""

    def inside(x: Column) -> Column:
        crossed = F.filter(found, lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (x < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
        return F.size(crossed) % 2 == 1

    return inside(lon) | inside(lon + 360)


def meets_box(found: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether an area and a box share a point; west > east crosses the antimeridian."""
    spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    out = F.lit(False)
    for a, b in spans:
        for shift in (0.0, 360.0):
            out = out | F.exists(found, _entering(a + shift, south, b + shift, north))
        # no edge in it: the box lies within the area, or apart
        out = out | holds(found, F.lit(a), F.lit(south))
    return out


def _entering(west: float, south: float, east: float, north: float) -> Callable[[Column], Column]:
    return lambda e: _enters(e, west, south, east, north)


def _enters(e: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether an edge has a part within a box: the shares of it within both pairs of sides."""
    begins, ends = [F.lit(0.0)], [F.lit(1.0)]
    apart = F.lit(False)
    for a, b, low, high in (("x1", "x2", west, east), ("y1", "y2", south, north)):
        step = F.nullif(e[b] - e[a], F.lit(0.0))
        t, u = (F.lit(low) - e[a]) / step, (F.lit(high) - e[a]) / step
        begins.append(F.coalesce(F.least(t, u), F.lit(0.0)))
        ends.append(F.coalesce(F.greatest(t, u), F.lit(1.0)))
        apart = apart | (step.isNull() & ((e[a] < low) | (e[a] > high)))
    return ~apart & (F.greatest(*begins) <= F.least(*ends))


def edge_nm_sql(lat: str, lon: str, e: str) -> str:
    """Distance in NM from a point to an edge ``e`` along a great circle: across it where the point
    is beside the edge, else to the nearer end."""
    a, b = (geo.haversine_sql(lat, lon, f"{e}.y{i}", f"{e}.x{i}") for i in (1, 2))
    length = geo.haversine_sql(f"{e}.y1", f"{e}.x1", f"{e}.y2", f"{e}.x2")
    turn = f"radians({geo.course_sql(f'{e}.y1', f'{e}.x1', lat, lon)} - {geo.course_sql(f'{e}.y1', f'{e}.x1', f'{e}.y2', f'{e}.x2')})"
    across = f"asin(greatest(-1e0, least(1e0, sin({a} / {RADIUS_NM}) * sin({turn}))))"
    along = f"atan2(sin({a} / {RADIUS_NM}) * cos({turn}), cos({a} / {RADIUS_NM})) * {RADIUS_NM}"
    return f"CASE WHEN {length} > 0 AND {along} BETWEEN 0e0 AND {length} THEN abs({across}) * {RADIUS_NM} ELSE least({a}, {b}) END"


def within_nm(found: str, lat: float, lon: float, reach_nm: float) -> Column:
    """Whether an area (its column of edges by name) holds a point or comes as near to it."""
    at = [f"{float(v)!r}e0" for v in (lat, lon)]
    near = F.expr(f"exists({found}, e -> {edge_nm_sql(*at, 'e')} <= {float(reach_nm)!r}e0)")
    return holds(F.col(found), F.lit(float(lon)), F.lit(float(lat))) | near
