"""Geometries of one fixed type, so that columns of mixed kinds have one schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions.geometry import GEOMETRY


def _of(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts")).cast(GEOMETRY)


def point(x: Column, y: Column) -> Column:
    return _of("Point", F.array(F.array(F.array(F.array(x.cast("double"), y.cast("double"))))))


def multipoint(points: Column) -> Column:
    return _of("MultiPoint", F.array(F.array(points)))


def linestring(points: Column) -> Column:
    return _of("LineString", F.array(F.array(points)))


def multilinestring(lines: Column) -> Column:
    return _of("MultiLineString", F.array(lines))


def polygon(rings: Column) -> Column:
    return _of("Polygon", F.array(rings))


def multipolygon(polygons: Column) -> Column:
    return _of("MultiPolygon", polygons)
