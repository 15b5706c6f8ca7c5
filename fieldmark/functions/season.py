"""Column expressions for dates in a season, distances and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_day(day: Column) -> Column:
    """Day of a year of 365 days; Feb 29 is 59.5."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.when(leap, 59.5).otherwise(F.dayofyear(F.make_date(F.lit(2001), F.month(day), F.when(leap, 28).otherwise(F.dayofmonth(day)))).cast("double"))


def season_week(day: Column) -> Column:
    """1..52; week 52 has the last eight days."""
    return F.least(F.lit(52), (F.floor((season_day(day) - 1) / 7) + 1).cast("int"))


def circular(a: Column, b: Column, around: int = 52) -> Column:
    d = F.abs(a - b)
    return F.least(d, around - d)


def recency(day: Column, now: Column, half_life_years: float = 3.0) -> Column:
    return F.pow(F.lit(2.0), -F.datediff(now, day) / 365.2425 / half_life_years)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6378137.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def band(x: Column, *bounds: float) -> Column:
    """How many bounds x reaches."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))
