"""Geographic column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean radius of the earth in km, and the WGS-84 ellipsoid.
EARTH_KM = 6371.0088
WGS_A, WGS_F = 6378.137, 1 / 298.257223563


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km on the mean sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def vincenty_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Distances on the WGS-84 ellipsoid by Vincenty's inverse formula (1975), of arrays or numbers; NaN where it doesn't converge or one is missing."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (lat1, lon1, lat2, lon2)))
    b = (1 - WGS_F) * WGS_A
    u1, u2 = np.arctan((1 - WGS_F) * np.tan(np.radians(lat1))), np.arctan((1 - WGS_F) * np.tan(np.radians(lat2)))
    diff = np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, out = diff.copy(), np.full(diff.shape, np.nan)
    out[(lat1 == lat2) & (lon1 == lon2)] = 0.0
    live = np.flatnonzero(np.isnan(out.ravel()) & np.isfinite(diff.ravel() + u1.ravel() + u2.ravel()))
    flat = [v.ravel()[live] for v in (s1, c1, s2, c2, diff, lam)]
    result = out.ravel()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            if not len(live):
                break
            s1, c1, s2, c2, diff, lam = flat
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            ca2 = 1 - sa * sa
            c2m = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
            c = WGS_F / 16 * ca2 * (4 + WGS_F * (4 - 3 * ca2))
            new = diff + (1 - c) * WGS_F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            done = (np.abs(lam - new) < 1e-12) | (ss == 0)
            if done.any():
                u = ca2 * (WGS_A**2 - b**2) / b**2
                big_a = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
                big_b = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
                turn = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m * c2m - 1) - big_b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
                result[live[done]] = np.where(ss == 0, 0.0, b * big_a * (sigma - turn))[done]
            flat = [v[~done] for v in (s1, c1, s2, c2, diff, new)]
            live = live[~done]
    return result.reshape(out.shape)


@F.pandas_udf(T.DoubleType())
def _ellipsoid(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    d = vincenty_km(*(v.to_numpy("float64", na_value=np.nan) for v in (lat1, lon1, lat2, lon2)))
    return pd.Series(d).astype("Float64").mask(np.isnan(d))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, method: str = "sphere") -> Column:
    """``sphere`` stays in the JVM; ``ellipsoid`` is an Arrow UDF that falls back to the sphere."""
    if method == "sphere":
        return haversine_km(lat1, lon1, lat2, lon2)
    if method != "ellipsoid":
        raise ValueError(f"unknown method {method!r}")
    return F.coalesce(_ellipsoid(lat1, lon1, lat2, lon2), haversine_km(lat1, lon1, lat2, lon2))


def box_middle(ring: Column) -> Column:
    """struct<lat, lon> of the middle of the extremes of a box's outline (lon, lat); null without points."""
    pts = F.filter(ring, lambda q: q.isNotNull() & F.get(q, F.lit(0)).isNotNull() & F.get(q, F.lit(1)).isNotNull())
    of = lambda f, i: f(F.transform(pts, lambda q: F.get(q, F.lit(i))))
    return F.when(
        F.size(pts) > 0,
        F.struct(((of(F.array_min, 1) + of(F.array_max, 1)) / 2).alias("lat"), ((of(F.array_min, 0) + of(F.array_max, 0)) / 2).alias("lon")),
    )
