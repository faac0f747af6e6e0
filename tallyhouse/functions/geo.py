"""Distances between points given in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, EARTH_KM, MILE_M = 6_371_000.0, 6371.0, 1609.344


def cosine_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines; the cosine is clamped to [-1, 1]."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.cos(a) * F.cos(b) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(a) * F.sin(b)
    return F.lit(EARTH_M) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))
