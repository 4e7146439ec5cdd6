"""Distances, offsets and geohashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muralis.config import DEGREE_M, EARTH_M

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    lon_half = F.sin(F.radians(lon2 - lon1) / 2)
    a = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * lon_half * lon_half
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def box_half(lat: Column, metres: float) -> tuple[Column, Column]:
    """Half sizes in degrees of the candidate box around a point."""
    dlat = F.lit(metres / DEGREE_M)
    return dlat, dlat / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))


def offset_m(lat: Column, lon: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """A point moved by metres east and north."""
    return lat + dy / DEGREE_M, lon + dx / (DEGREE_M * F.cos(F.radians(lat)))


def geohash(lat: Column, lon: Column, precision: int = 8) -> Column:
    """Base-32 geohash.  Latitude and longitude become integers of the needed bits; each character takes its five
    bits from both in turn, longitude first."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << n_lon)), F.lit((1 << n_lon) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << n_lat)), F.lit((1 << n_lat) - 1)).cast("long")
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            k = 5 * c + b
            source, at = (x, n_lon - 1 - k // 2) if k % 2 == 0 else (y, n_lat - 1 - k // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1))
        chars.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)
