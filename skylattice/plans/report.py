"""A plan as text: for one request, collected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, NOTHING = 100, "—"
_MODES = {"vor-family": "VOR-family only", "ndb-fallback": "NDB fallback"}


def _nm(x: float) -> str:
    return f"{x:.1f} NM"


def _course(x: float | None) -> str:
    return NOTHING if x is None else f"{math.floor(x + 0.5) % 360:03d}°"


def course_text(c: str) -> Column:
    """A course in a table of many plans, as the report writes it."""
    figures = F.lpad((F.floor(F.col(c) + 0.5) % 360).cast("string"), 3, "0")
    return F.coalesce(F.concat(figures, F.lit("°")), F.lit(NOTHING))


def _guidance(x: float | None, label: str) -> str:
    return NOTHING if x is None else f"{label} {_course(x)}"


def _frequency(value: float, unit: str) -> str:
    return f"{value:.2f} MHz" if unit == "MHz" else f"{value:g} kHz"


def _table(columns: list[tuple[str, bool]], rows: list[list[str]]) -> list[str]:
    """Lines of a table; a column's flag puts its cells to the right."""
    widths = [max(len(x) for x in (name, *(r[i] for r in rows))) for i, (name, _) in enumerate(columns)]
    lines = [[name for name, _ in columns], *rows]
    return ["  ".join(x.rjust(w) if right else x.ljust(w) for x, w, (_, right) in zip(line, widths, columns)).rstrip() for line in lines]


def _sequence(names: list[str]) -> list[str]:
    prefix, lines = "Route Points: ", []
    line = prefix
    for n in names:
        gap = "" if line == prefix else " → "
        if line != prefix and len(line) + len(gap) + len(n) > WIDTH:
            lines.append(line)
            line = " " * len(prefix) + n
        else:
            line += gap + n
    return [*lines, line]


# Heads of the tables' columns.
LEGS = [("Leg", True), ("From", False), ("To", False), ("Distance", True), ("Outbound True", True), ("Arrival True", True), ("Outbound Magnetic", True), ("Arrival Magnetic", True), ("Departure VOR Guidance", False), ("Arrival VOR Guidance", False)]
NAVAIDS = [("Identifier", False), ("Type", False), ("Frequency", True), ("Published Range", True)]


def render(plan, legs: list) -> str:
    """The text of a found plan (a row of plan_routes) and its legs in order."""
    legs = sorted(legs, key=lambda x: x["leg"])
    points = [legs[0]["departure"], *(x["arrival"] for x in legs)]
    rows = [[str(x["leg"]), x["departure"]["identifier"], x["arrival"]["identifier"], _nm(x["distance_nm"]), _course(x["departure_true"]), _course(x["arrival_true"]), _course(x["departure_magnetic"]), _course(x["arrival_magnetic"]), _guidance(x["departure_guidance"], "Outbound"), _guidance(x["arrival_guidance"], "Inbound")] for x in legs]
    navaids = {p["database_id"]: p for p in reversed(points) if p["kind"] != "airport"}
    order = dict.fromkeys(p["database_id"] for p in points if p["kind"] != "airport")
    told = [[navaids[i]["identifier"], navaids[i]["family"], _frequency(navaids[i]["frequency_value"], navaids[i]["frequency_unit"]), _nm(navaids[i]["published_range_nm"])] for i in order]
    head = [*_sequence([p["identifier"] for p in points]), f"Total Distance: {_nm(plan['total_nm'])}", f"Route Legs: {len(legs)}", f"Route Search Mode: {_MODES[plan['mode']]}"]
    return "\n".join([*head, "", "Route Legs", *_table(LEGS, rows), "", "Navaids", *_table(NAVAIDS, told)]) + "\n"


def report(plans: DataFrame, legs: DataFrame, request_id: str) -> str:
    """The text for one request: its plan, or its status."""
    plan = plans.filter(plans["request_id"] == request_id).first()
    if plan is None or plan["status"] != "found":
        return f"{request_id}: {'unknown' if plan is None else plan['status']}\n"
    return render(plan, legs.filter(legs["request_id"] == request_id).collect())
