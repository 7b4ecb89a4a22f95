"""Points on a sphere as column expressions: normal form, haversine, windows and cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres: the mean radius that distances are on.
RADIUS = 6_371_000.0


def clamp_lat(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0))


def normal_lng(lng: Column) -> Column:
    """To [-180, 180). What is there already stays as it is to the bit; non-finite becomes null."""
    finite = (~F.isnan(lng)) & (F.abs(lng) < float("inf"))
    moved = F.pmod(lng + 180.0, F.lit(360.0)) - 180.0
    return F.when((lng >= -180.0) & (lng < 180.0), lng).when(finite, moved)


def haversine_term(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lng2 - lng1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def unit(points: DataFrame) -> DataFrame:
    """Points (lat, lng) with their place (x, y, z) on the unit sphere."""
    lat, lng = F.radians(F.col("lat")), F.radians(F.col("lng"))
    return points.withColumns({"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)})


def chord_term(a: str, b: str) -> Column:
    """The haversine term of two points of unit(), from the chord between them: no sines, equal but for rounding."""
    x, y, z = (F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz")
    return (x * x + y * y + z * z) * 0.25


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points in normal form."""
    return 2 * RADIUS * F.asin(F.sqrt(F.least(haversine_term(lat1, lng1, lat2, lng2), F.lit(1.0))))


def largest_term(radius_m: Column) -> Column:
    """The haversine term of a radius: all of the sphere from half its girth on, nothing (-1) below zero."""
    s = F.sin(radius_m / (2 * RADIUS))
    return F.when(radius_m < 0, F.lit(-1.0)).when(radius_m >= math.pi * RADIUS, F.lit(2.0)).otherwise(s * s)


def half_height(radius_m: Column) -> Column:
    """Degrees of latitude that a radius spans to either side, with a hair's margin for rounding."""
    return F.degrees(radius_m / RADIUS) + 1e-9


def half_width(lat: Column, radius_m: Column) -> Column:
    """Degrees of longitude to either side of a cap's centre; 180 where it holds a pole."""
    reach = radius_m / RADIUS
    polar = F.radians(F.abs(lat)) + reach >= math.pi / 2
    inside = F.least(F.sin(reach) / F.cos(F.radians(lat)), F.lit(1.0))
    return F.when(polar, F.lit(180.0)).otherwise(F.least(F.degrees(F.asin(inside)) + 1e-9, F.lit(180.0)))


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / degrees).cast("long")
