"""Great-circle geometry as column expressions; kilometres unless another unit is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
_UNITS = {"km": 1.0, "m": 1000.0}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    if unit not in _UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((p2 - p1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * EARTH_KM * _UNITS[unit]) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def within_radius(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, radius_km: float) -> Column:
    return haversine(lat, lon, centre_lat, centre_lon) <= radius_km


def chord_distance(lat: Column, lon: Column, start: tuple[Column, Column], end: tuple[Column, Column]) -> Column:
    """Height of the triangle over the segment; the nearer end if the segment has no length."""
    a, b, c = haversine(*start, *end), haversine(lat, lon, *start), haversine(lat, lon, *end)
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))
    return F.when(a < 1e-9, F.least(b, c)).otherwise(F.try_divide(2 * area, a))
