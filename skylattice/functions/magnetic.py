"""Magnetic declination from a spherical-harmonic model of the main field.

Coefficients are a parameter: rows of degree n, order m, g, h and their yearly changes, as in
the text file that the model's publishers issue. Gauss coefficients are Schmidt
semi-normalised; the sums run over the geocentric direction of the geodetic point.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Reference radius of the models and the WGS84 ellipsoid, in km; the weakest horizontal
#: field, in nT, in which a compass points anywhere.
_REFERENCE, _MAJOR, _FLATTENING = 6371.2, 6378.137, 1 / 298.257223563
WEAK_NT, YEARS = 2000.0, 5.0


class MagneticModel:
    """Name, epoch and coefficients of one model, valid for five years from its epoch."""

    def __init__(self, name: str, epoch: float, rows: list[tuple[int, int, float, float, float, float]]):
        self.name, self.epoch = name, float(epoch)
        self.degree = max(r[0] for r in rows)
        self.table = np.zeros((4, self.degree + 1, self.degree + 1))
        for n, m, *values in rows:
            self.table[:, n, m] = values

    @classmethod
    def read(cls, text: str) -> MagneticModel:
        """From the published text: a line with epoch and name, then one for each (n, m), up to
        a line of nines."""
        lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("9999")]
        head, rows = lines[0], [(int(x[0]), int(x[1]), *map(float, x[2:6])) for x in lines[1:]]
        return cls(head[1], float(head[0]), rows)

    def declination(self, year, lat, lon, height_km: float = 0.0) -> np.ndarray:
        """Degrees east in [-180, 180); NaN where the horizontal field is under WEAK_NT.

        year: decimal year in [epoch, epoch + 5); lat in [-90, 90]; lon in [-180, 180).
        """
        year, lat, lon = np.broadcast_arrays(*(np.asarray(x, np.float64) for x in (year, lat, lon)))
        if (~((year >= self.epoch) & (year < self.epoch + YEARS) & (np.abs(lat) <= 90) & (lon >= -180) & (lon < 180))).any():
            raise ValueError("outside the domain of the magnetic model")
        phi, lam = np.radians(lat), np.radians(lon)
        e2 = _FLATTENING * (2 - _FLATTENING)
        normal = _MAJOR / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        p, z = (normal + height_km) * np.cos(phi), (normal * (1 - e2) + height_km) * np.sin(phi)
        r, beta = np.hypot(p, z), np.arctan2(z, p)
        x = np.sin(beta)
        # at the poles the east component needs a cosine that isn't zero
        c = np.maximum(np.cos(beta), 1e-12)
        legendre, slope = self._legendre(x, c)
        since = year - self.epoch
        north = east = down = 0.0
        for n in range(1, self.degree + 1):
            scale = (_REFERENCE / r) ** (n + 2)
            for m in range(n + 1):
                g = self.table[0, n, m] + since * self.table[2, n, m]
                h = self.table[1, n, m] + since * self.table[3, n, m]
                swing = g * np.cos(m * lam) + h * np.sin(m * lam)
                north = north - scale * swing * slope[n, m]
                east = east + scale * m * (g * np.sin(m * lam) - h * np.cos(m * lam)) * legendre[n, m] / c
                down = down - scale * (n + 1) * swing * legendre[n, m]
        turn = beta - phi  # from the geocentric to the geodetic vertical
        level = north * np.cos(turn) - down * np.sin(turn)
        angle = np.degrees(np.arctan2(east, level))
        angle = np.where(angle >= 180, angle - 360, angle)
        return np.where(np.hypot(level, east) < WEAK_NT, np.nan, angle)

    def _legendre(self, x, c):
        """Schmidt functions of the sine of latitude, and their slopes by latitude."""
        size = (self.degree + 1, self.degree + 1, *np.shape(x))
        p, d = np.zeros(size), np.zeros(size)
        p[0, 0] = 1.0
        for n in range(1, self.degree + 1):
            for m in range(n + 1):
                if n == m:
                    k = 1.0 if n == 1 else np.sqrt((2 * n - 1) / (2 * n))
                    p[n, n] = k * c * p[n - 1, n - 1]
                    d[n, n] = k * (c * d[n - 1, n - 1] - x * p[n - 1, n - 1])
                else:
                    a, b = (2 * n - 1) / np.sqrt(n * n - m * m), np.sqrt(max(0, (n - 1) ** 2 - m * m)) / np.sqrt(n * n - m * m)
                    before = p[n - 2, m] if n > 1 else 0.0
                    before_d = d[n - 2, m] if n > 1 else 0.0
                    p[n, m] = a * x * p[n - 1, m] - b * before
                    d[n, m] = a * (x * d[n - 1, m] + c * p[n - 1, m]) - b * before_d
        return p, d

    def udf(self):
        """declination(year, lat, lon) as a vectorised function; null where it is undefined."""
        model = self

        @F.pandas_udf(DoubleType())
        def declination(year: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
            known = year.notna() & lat.notna() & lon.notna()
            out = np.full(len(year), np.nan)
            if known.any():
                out[known] = model.declination(year[known], lat[known], lon[known])
            return pd.Series(out, dtype="Float64").mask(np.isnan(out))

        return declination


def decimal_year(date: Column) -> Column:
    """The year and the share of its days that have gone."""
    days = F.when((F.year(date) % 4 == 0) & ((F.year(date) % 100 != 0) | (F.year(date) % 400 == 0)), 366.0).otherwise(365.0)
    return F.year(date) + (F.dayofyear(date) - 1) / days


def decimal_year_of(date: dt.date) -> float:
    first, after = dt.date(date.year, 1, 1), dt.date(date.year + 1, 1, 1)
    return date.year + (date - first).days / (after - first).days
