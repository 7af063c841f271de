"""Projections and planar distances as closed-form Column expressions (no Python per row)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS80 / WGS84 ellipsoids and the parameters of the EPSG:5070 and UTM definitions.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
ALBERS_LAT1, ALBERS_LAT2, ALBERS_LAT0, ALBERS_LON0 = 29.5, 45.5, 23.0, -96.0
UTM_K0, UTM_FALSE_EASTING, UTM_EPSG_BASE = 0.9996, 500000.0, 32600


def albers_constants() -> dict[str, float]:
    """e, n, C and rho0 of the ellipsoidal Albers equal-area projection with the EPSG:5070 parameters."""
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m(lat):
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - e * e * s * s)

    def q(lat):
        s = math.sin(math.radians(lat))
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    n = (m(ALBERS_LAT1) ** 2 - m(ALBERS_LAT2) ** 2) / (q(ALBERS_LAT2) - q(ALBERS_LAT1))
    c = m(ALBERS_LAT1) ** 2 + n * q(ALBERS_LAT1)
    rho0 = GRS80_A * math.sqrt(c - n * q(ALBERS_LAT0)) / n
    return {"e": e, "n": n, "c": c, "rho0": rho0}


def albers_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lon/lat in degrees to EPSG:5070 metres."""
    k = albers_constants()
    e, n = k["e"], k["n"]
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * (e * e)) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e * e)
    rho = F.sqrt(k["c"] - q * n) * (GRS80_A / n)
    theta = F.radians(lon - ALBERS_LON0) * n
    return rho * F.sin(theta), k["rho0"] - rho * F.cos(theta)


def project_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add x, y in EPSG:5070 metres."""
    x, y = albers_xy(F.col(lon), F.col(lat))
    return df.withColumns({"x": x, "y": y})


def project_edges(df: DataFrame) -> DataFrame:
    """Replace the lon/lat end points x1,y1,x2,y2 by EPSG:5070 metres; sides stay straight lines."""
    ax, ay = albers_xy(F.col("x1"), F.col("y1"))
    bx, by = albers_xy(F.col("x2"), F.col("y2"))
    return df.withColumns({"x1": ax, "y1": ay, "x2": bx, "y2": by})


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon: Column) -> Column:
    """EPSG code of the northern UTM zone that holds a longitude."""
    return utm_zone(lon) + UTM_EPSG_BASE


def utm_xy(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Northern UTM metres by the Krueger series to third order (millimetres within a zone)."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    dl = F.radians(lon - (zone * 6.0 - 183.0))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, coef in enumerate(alpha, start=1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * coef
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * coef
    return east * (UTM_K0 * a) + UTM_FALSE_EASTING, north * (UTM_K0 * a)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance from a point to a segment; a zero-length segment is a point.

    Beyond an end the end point itself is used, so segments sharing a vertex give bit-equal distances.
    """
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.when(len2 > 0, len2), F.lit(0.0))
    fx = F.when(t <= 0, x1).when(t >= 1, x2).otherwise(x1 + t * dx)
    fy = F.when(t <= 0, y1).when(t >= 1, y2).otherwise(y1 + t * dy)
    return F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy))
