"""Planner relations derived anew for the date of a magnetic model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.magnetic import MagneticModel, decimal_year_of
from skylattice.schema import METADATA


def with_declination(rows: DataFrame, model: MagneticModel, day: dt.date) -> DataFrame:
    """``rows`` (longitude, latitude) with magnetic_declination_deg_east for a day, in place of
    what they had; null where the model gives none."""
    return rows.withColumn("magnetic_declination_deg_east", model.udf()(F.lit(decimal_year_of(day)), F.col("latitude"), F.col("longitude")))


def planner_airports(cached: DataFrame, model: MagneticModel, day: dt.date) -> DataFrame:
    """Planner airports of all cached ones."""
    return with_declination(cached.select("database_id", "icao", "name", "longitude", "latitude"), model, day)


def planner_metadata(spark, model: MagneticModel, day: dt.date, version: str, source: str) -> DataFrame:
    """The one row that says which model the declinations are of."""
    return spark.createDataFrame([(model.name, version, model.epoch, day, source)], METADATA)
