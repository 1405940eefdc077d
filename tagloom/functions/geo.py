"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth that lengths are computed with, in metres.
EARTH_RADIUS_M = 6_372_797.560856


def haversine(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column) -> Column:
    """Great-circle distance in metres between two places in degrees; NULL if one of them is."""
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in (lat1, lon1, lat2, lon2))
    up, along = F.sin(F.radians(c - a) / 2), F.sin(F.radians(d - b) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(up * up + F.cos(F.radians(a)) * F.cos(F.radians(c)) * along * along)))
