"""Coordinate systems and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the BD-09 and GCJ-02 systems.
X_PI = math.pi * 3000 / 180
AXIS, ECCENTRICITY = 6378245.0, 0.006693421622965943


def ordered(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """lon, lat and whether they were given the other way round; null where they are no place on earth."""
    swapped = (F.abs(lon) <= 90) & (F.abs(lat) > 90) & (F.abs(lat) <= 180)
    x, y = F.when(swapped, lat).otherwise(lon), F.when(swapped, lon).otherwise(lat)
    good = (F.abs(x) <= 180) & (F.abs(y) <= 90)
    return F.when(good, x), F.when(good, y), F.coalesce(swapped, F.lit(False))


def bd09_to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 0.0065, lat - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * X_PI)
    theta = F.atan2(y, x) - 0.000003 * F.cos(x * X_PI)
    return z * F.cos(theta), z * F.sin(theta)


def _waves(x: Column, parts: tuple[tuple[float, float], ...]) -> Column:
    """Two thirds of a sum of sines: (height, turns of pi)."""
    return sum((h * F.sin(x * (k * math.pi)) for h, k in parts), F.lit(0.0)) * (2 / 3)


def gcj02_shift(lon: Column, lat: Column) -> tuple[Column, Column]:
    """How far GCJ-02 puts a WGS-84 place away, in degrees."""
    x, y = lon - 105, lat - 35
    both = _waves(x, ((20, 6), (20, 2)))
    east = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + both + _waves(x, ((20, 1), (40, 1 / 3))) + _waves(x, ((150, 1 / 12), (300, 1 / 30)))
    north = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + both + _waves(y, ((20, 1), (40, 1 / 3))) + _waves(y, ((160, 1 / 12), (320, 1 / 30)))
    bend = 1 - ECCENTRICITY * F.pow(F.sin(F.radians(lat)), 2)
    return F.degrees(east * F.sqrt(bend) / AXIS / F.cos(F.radians(lat))), F.degrees(north * bend * F.sqrt(bend) / (AXIS * (1 - ECCENTRICITY)))


def gcj02_to_wgs84(df: DataFrame, lon: str, lat: str, steps: int = 8) -> DataFrame:
    """df with lon and lat turned back by fixed-point steps; one projection a step, so that no step is computed twice."""
    out = df.withColumns({"_lon": F.col(lon), "_lat": F.col(lat)})
    for _ in range(steps):
        east, north = gcj02_shift(F.col("_lon"), F.col("_lat"))
        out = out.withColumns({"_lon": F.col(lon) - east, "_lat": F.col(lat) - north})
    return out.withColumns({lon: F.col("_lon"), lat: F.col("_lat")}).drop("_lon", "_lat")


def inside(lon: Column, lat: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a place lies in the polygon: it crosses an odd number of edges on its way east."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[-1:] + polygon[:-1]):
        if y1 != y2:
            crossed = crossed + F.when(((lat < y1) != (lat < y2)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1
