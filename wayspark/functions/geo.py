"""Geodesy as column expressions: everything stays inside generated code."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius (m) and metres per degree used for padding.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_195.0

_RAD = math.radians(1.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    # not least(): it would turn a missing position into a distance
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def x_scale(lat0: float | Column):
    """Metres per degree of longitude at ``lat0`` (a number or a column)."""
    if isinstance(lat0, Column):
        return _RAD * EARTH_RADIUS_M * F.cos(F.radians(lat0))
    return _RAD * EARTH_RADIUS_M * math.cos(math.radians(lat0))


Y_SCALE = _RAD * EARTH_RADIUS_M


def to_xy(lat: Column, lon: Column, lat0, lon0) -> tuple[Column, Column]:
    """Equirectangular metres around a reference point."""
    return (lon - lon0) * x_scale(lat0), (lat - lat0) * Y_SCALE


def to_latlon(x: Column, y: Column, lat0, lon0) -> tuple[Column, Column]:
    return y / Y_SCALE + lat0, x / x_scale(lat0) + lon0


def time_of_day(t: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day."""
    angle = F.pmod(t, F.lit(86400.0)) / 86400.0 * (2 * math.pi)
    return F.sin(angle), F.cos(angle)


def weekday(t: Column) -> Column:
    """Weekday scaled to [0, 1]; day 0 of the epoch was a Thursday."""
    return F.pmod(F.floor(t / 86400.0) + 3, F.lit(7)) / 6.0
