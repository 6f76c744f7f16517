"""Text, number and date functions of the producer, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First effective date of the 28-day cycles, and their length.
CYCLE_START, CYCLE_DAYS = "2025-01-23", 28


def stripped(c: Column) -> Column:
    """Without white space at either end, whatever its kind."""
    return F.regexp_replace(c, r"(?U)\A[\s﻿]+|[\s﻿]+\z", "")


def non_blank(c: Column) -> Column:
    """Stripped; null where nothing is left."""
    s = stripped(c)
    return F.when(s != "", s)


def icao(c: Column) -> Column:
    """Normalised four-letter code; null where it isn't one."""
    s = F.upper(stripped(c))
    return F.when(s.rlike(r"\A[A-Z]{4}\z"), s)


def megahertz_to_hertz(c: Column) -> Column:
    """Exact hertz of text like 112.3; null where it isn't that or not above zero."""
    s = stripped(c)
    hz = (s.try_cast("decimal(12,6)") * 1_000_000).cast("long")
    return F.when(s.rlike(r"\A\d{1,3}(\.\d{1,6})?\z") & (hz > 0), hz)


def signed_variation(magnitude: Column, hemisphere: Column, year: Column) -> Column:
    """Degrees east, in [-180, 180), from a magnitude, E or W, and a four-digit year; else null."""
    m, h, y = stripped(magnitude), F.upper(stripped(hemisphere)), stripped(year)
    value = F.when(h == "W", -m.try_cast("double")).otherwise(m.try_cast("double"))
    good = m.rlike(r"\A\d+(\.\d+)?\z") & h.isin("E", "W") & y.rlike(r"\A\d{4}\z") & (y.try_cast("int") > 0)
    return F.when(good & (value >= -180) & (value < 180), value + F.lit(0.0))


def cycle_date(day: Column) -> Column:
    """Effective date of the cycle that a day lies in."""
    return F.date_add(F.lit(CYCLE_START).cast("date"), (F.floor(F.datediff(day, F.lit(CYCLE_START).cast("date")) / CYCLE_DAYS) * CYCLE_DAYS).cast("int"))


def cycle_id(effective: Column) -> Column:
    """YYnn: the year and the number of the cycle in it."""
    first = F.dayofyear(effective)
    return F.concat(F.date_format(effective, "yy"), F.lpad((F.floor((first - 1) / CYCLE_DAYS) + 1).cast("string"), 2, "0"))


def archive_date(effective: Column) -> Column:
    return F.date_format(effective, "dd_MMM_yyyy")


def sha256_tag(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def is_date(c: Column) -> Column:
    """Whether text is a calendar date as YYYY-MM-DD."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == c, F.lit(False))


def is_timestamp(c: Column) -> Column:
    """Whether text is a UTC time in milliseconds as YYYY-MM-DDThh:mm:ss.sssZ."""
    written = r"\A\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3}Z\z"
    return F.coalesce(c.rlike(written) & is_date(F.substring(c, 1, 10)), F.lit(False))
