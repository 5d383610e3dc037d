"""GeoJSON text of geometries: struct<kind, parts>, parts always being polygons of rings of points of x and y."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions.scalars import is_finite, json_shortest

GEOMETRY = "struct<kind:string,parts:array<array<array<array<double>>>>>"
KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


#: Stands for what can't be written until the whole geometry is given up; no coordinate's text holds it.
UNSOUND = "!"


def _pair(p: Column) -> Column:
    """x and y; further coordinates are left out. Null if one is missing or not finite."""
    x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when(is_finite(x) & is_finite(y), F.concat(F.lit("["), json_shortest(x), F.lit(","), json_shortest(y), F.lit("]")))


def _first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def _all(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ",", UNSOUND), F.lit("]"))


def _coordinates(parts: Column, kind: str) -> Column:
    """From polygons of rings of points that are written already."""
    if kind == "Point":
        return _first(_first(_first(parts)))
    if kind in ("MultiPoint", "LineString"):
        return _all(_first(_first(parts)))
    if kind in ("MultiLineString", "Polygon"):
        return _all(F.transform(_first(parts), _all))
    return _all(F.transform(parts, lambda polygon: _all(F.transform(polygon, _all))))


def _object(geometry: Column, written: Column, kinds: list[str]) -> Column:
    text = F.lit(None).cast("string")
    for k in kinds:
        own = F.concat(F.lit(f'{{"type":"{k}","coordinates":'), _coordinates(written, k), F.lit("}"))
        text = F.when(geometry["kind"] == k, own).otherwise(text)
    return text


def geometry_json(geometry: Column, kinds: Iterable[str] = KINDS) -> Column:
    """The geometry's object; null for null geometries, other kinds, and those with a missing part or a coordinate that is missing or not finite.

    Name the kinds that a column holds if they are known: only their branches are built.
    """
    kinds = list(kinds)
    if kinds == ["Point"]:
        point = F.concat(F.lit('{"type":"Point","coordinates":'), _pair(_first(_first(_first(geometry["parts"])))), F.lit("}"))
        return F.coalesce(F.when(geometry["kind"] == "Point", point), F.lit("null"))
    # Points are written once, for all kinds.
    written = F.transform(geometry["parts"], lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, _pair)))
    text = _first(F.transform(F.array(written), lambda x: _object(geometry, x, kinds)))
    return F.coalesce(_first(F.transform(F.array(text), lambda x: F.when(~F.contains(x, F.lit(UNSOUND)), x))), F.lit("null"))
