"""Distance on the WGS84 ellipsoid, vectorised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: WGS84: major axis in metres, flattening.
_A, _F = 6_378_137.0, 1 / 298.257223563
ROUNDS, CLOSE = 200, 1e-12


def inverse_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between points by Vincenty's inverse formula; zero where they coincide, infinite
    where the iteration doesn't settle (nearly antipodal points)."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.radians(np.asarray(x, np.float64)) for x in (lat1, lon1, lat2, lon2)))
    b = _A * (1 - _F)
    u1, u2 = np.arctan((1 - _F) * np.tan(lat1)), np.arctan((1 - _F) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    # the short way round
    gap = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    out = np.full(gap.shape, np.inf)
    lam = gap.copy()
    open_ = np.isfinite(gap)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca2 = 1 - sa**2
            cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
            k = _F / 16 * ca2 * (4 + _F * (4 - 3 * ca2))
            new = gap + (1 - k) * _F * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
            done = open_ & ((np.abs(new - lam) <= CLOSE) | (ss == 0))
            if done.any():
                up = ca2 * (_A**2 - b**2) / b**2
                big = 1 + up / 16384 * (4096 + up * (-768 + up * (320 - 175 * up)))
                small = up / 1024 * (256 + up * (-128 + up * (74 - 47 * up)))
                turn = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
                out = np.where(done, np.where((ss == 0) & (cs > 0), 0.0, np.where(ss == 0, np.inf, b * big * (sigma - turn))), out)
                open_ = open_ & ~done
            if not open_.any():
                break
            lam = np.where(open_, new, lam)
    return out


@F.pandas_udf(DoubleType())
def wgs84_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(inverse_m(lat1, lon1, lat2, lon2))
