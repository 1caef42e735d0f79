"""Distances on the sphere and planar ray casting, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from wattlink import constants as K


def _radians(c: Column) -> Column:
    return c * math.pi / 180


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km on a sphere of radius 6371 km."""
    half_lat = F.sin(_radians(lat2 - lat1) / 2)
    half_lng = F.sin(_radians(lng2 - lng1) / 2)
    h = half_lat * half_lat + F.cos(_radians(lat1)) * F.cos(_radians(lat2)) * (half_lng * half_lng)
    return F.asin(F.sqrt(h)) * (2 * K.EARTH_RADIUS_KM)


def unit_vector(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere. The straight-line chord between two such points is a growing
    function of the haversine distance for every real latitude and longitude, so cells cut from
    (x, y, z) need no special cases at the poles or at the antimeridian."""
    phi, lam = _radians(lat), _radians(lng)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_of_km(km: float) -> float:
    """Chord length on the unit sphere that belongs to a distance on the earth."""
    return 2.0 * math.sin(min(km / (2 * K.EARTH_RADIUS_KM), math.pi / 2))


def crosses(x: Column, y: Column, edge: Column) -> Column:
    """Whether the ray from (x, y) to the right crosses the edge struct (xi, yi, xj, yj)."""
    xi, yi, xj, yj = (edge[f] for f in ("xi", "yi", "xj", "yj"))
    rise = F.when(yj == yi, F.lit(2.0**-52)).otherwise(yj - yi)
    return ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / rise + xi)
