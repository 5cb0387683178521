"""Great-circle expressions on decimal degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def _rad(c: Column) -> Column:
    return F.radians(c)


def half_chord_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine term ``a``, clipped to [0, 1]."""
    dlat = _rad(lat2) - _rad(lat1)
    dlon = _rad(lon2) - _rad(lon1)
    s_lat = F.sin(dlat / 2.0)
    s_lon = F.sin(dlon / 2.0)
    a = s_lat * s_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * (s_lon * s_lon)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres."""
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(half_chord_sq(lat1, lon1, lat2, lon2)))


def radius_half_chord_sq(radius_m: float) -> float:
    """Value of ``a`` for two points exactly ``radius_m`` apart."""
    return math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2.0) ** 2


def grid_key(coordinate: Column) -> Column:
    """Coordinate rounded to two decimals, as an integer count of hundredths."""
    return F.round(coordinate * 100.0).cast("bigint")
