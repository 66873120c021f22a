"""Distances and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    x = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(x, F.lit(1.0))))


def routing_string(line: Column) -> Column:
    """``lon,lat;lon,lat`` of an array of (lat, lon); null for fewer than two points."""
    return F.when(F.size(line) >= 2, F.array_join(F.transform(line, lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"))), ";"))


def swap(line: Column) -> Column:
    """(lat, lon) pairs as (lon, lat) ones."""
    return F.transform(line, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor zero; else 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(0.0))
