"""Distances, bearings and grid cells as column expressions. Coordinates are degrees; distances are kilometres.

Operators keep the distance formula they are defined with: haversine, spherical law of cosines, or chord."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DEGREE_KM = 111.195


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cosines_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def chord_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    def xyz(lat, lon):
        return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))

    return EARTH_KM * F.sqrt(sum((F.pow(p - q, 2) for p, q in zip(xyz(lat1, lon1), xyz(lat2, lon2))), F.lit(0.0)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, 0 <= b < 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def compass(b: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.floor(b / 45.0 + 0.5), F.lit(8)) + 1).cast("int"))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def cell_area_km2(lat_cell: Column, size: float) -> Column:
    """The area of a cell of size x size degrees at its middle latitude."""
    return (size * DEGREE_KM) ** 2 * F.cos(F.radians((lat_cell + 0.5) * size))


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile numbers."""
    n = float(1 << zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(F.radians(lat)) + 1.0 / F.cos(F.radians(lat))) / math.pi) / 2.0 * n)
    return F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), x)).cast("int"), F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), y)).cast("int")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Bounding box; west > east crosses the date line; full width skips the longitude."""
    rows = lat.between(south, north)
    if east - west >= 360:
        return rows
    return rows & (lon.between(west, east) if west <= east else (lon >= west) | (lon <= east))
