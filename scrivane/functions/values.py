"""Text of values in each context: table cells, vectors, matrices, nested tables, named and unnamed lists.

What is missing looks different in each, so each context has a function of its own. The choice by type happens once,
when the plan is built.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivane.functions.local import json_key, local_json
from scrivane.functions.scalars import FLOATING, FULL_TIMESTAMP, SCALARS, is_finite, json_string, scalar_text

NA, NAN, INF, MINUS_INF, EMPTY = '"NA"', '"NaN"', '"Inf"', '"-Inf"', "{}"


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def vector_item(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column:
    """In a vector, a missing value is "NA"; numbers that aren't finite are "NaN", "Inf" and "-Inf"."""
    text = scalar_text(c, kind, pattern)
    if isinstance(kind, FLOATING):
        text = F.when(F.isnan(c), NAN).when(c == float("inf"), INF).when(c == float("-inf"), MINUS_INF).otherwise(text)
    return F.coalesce(text, F.lit(NA))


def matrix_item(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column:
    """In a matrix column, all that is missing or not finite is "NA"."""
    text = scalar_text(c, kind, pattern)
    if isinstance(kind, FLOATING):
        text = F.when(is_finite(c), text)
    return F.coalesce(text, F.lit(NA))


def nested_cell(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column:
    """In a nested table, all that is missing or not finite is null, and its property stays."""
    if not isinstance(kind, SCALARS):
        return value_json(c, kind, pattern)
    text = scalar_text(c, kind, pattern)
    if isinstance(kind, FLOATING):
        text = F.when(is_finite(c), text)
    return F.coalesce(text, F.lit("null"))


def cell(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column | None:
    """In a table, null if the property is to be left out. None for kinds that no table shows."""
    if isinstance(kind, SCALARS):
        text = scalar_text(c, kind, pattern)
        return F.when(is_finite(c), text) if isinstance(kind, FLOATING) else text
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return value_json(c, kind, pattern)
    return None


def matrix_cell(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column:
    """A row of a matrix column."""
    item = kind.elementType
    return F.coalesce(_list(F.transform(c, lambda x: matrix_item(x, item, pattern) if isinstance(item, SCALARS) else value_json(x, item, pattern))), F.lit(EMPTY))


def vector(c: Column, item: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column:
    return _list(F.transform(c, lambda x: vector_item(x, item, pattern)))


def matrix(c: Column, item: T.DataType, rows: Column | None = None, columns: Column | None = None) -> Column:
    """A matrix as an array of rows: from nested arrays, or with rows and columns from one array that holds it column by column."""
    if rows is None or columns is None:
        return _list(F.transform(c, lambda row: F.coalesce(vector(row, item), F.lit(EMPTY))))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda r, k: vector_item(F.get(c, r + k * rows), item)
    return _list(F.transform(upto(rows.cast("int")), lambda r: _list(F.transform(upto(columns.cast("int")), lambda k: at(r, k)))))


def nested_object(c: Column, kind: T.StructType, pattern: str = FULL_TIMESTAMP) -> Column:
    return _object([(f.name, nested_cell(c.getField(f.name), f.dataType, pattern)) for f in kind.fields])


def _object(properties: list[tuple[str, Column]]) -> Column:
    if not properties:
        return F.lit("{}")
    parts = [F.concat(F.lit(("," if k else "{") + json_key(name)), text) for k, (name, text) in enumerate(properties)]
    return F.concat(*parts, F.lit("}"))


def has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return has_variant(kind.valueType)
    return has_variant(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.VariantType)


def variant_json(sort: bool):
    """From the JSON of a value whose kinds only the rows know, by the rules for Python values: the one place where Python works on executors."""

    @F.arrow_udf("string")
    def encoded(texts: pa.Array) -> pa.Array:
        values = (None if t is None else json.loads(t) for t in texts.to_pylist())
        return pa.array([None if v is None else local_json({k: v[k] for k in sorted(v)} if sort else v) for v in values], pa.string())

    return encoded


def value_json(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column:
    """A value that stands for itself or in a list. A single value is a vector of one; null lists and unknown kinds are {}.

    Variants, and lists and maps that hold them, are written by the rules for Python values: single values are vectors of
    one, lists of one kind of single values vectors; what is missing within a list or object is ["NA"].
    """
    if isinstance(kind, SCALARS):
        return F.concat(F.lit("["), vector_item(c, kind, pattern), F.lit("]"))
    if isinstance(kind, T.VariantType) or isinstance(kind, (T.ArrayType, T.MapType)) and has_variant(kind):
        text = variant_json(isinstance(kind, T.MapType))(F.to_json(c))
    elif isinstance(kind, T.ArrayType):
        item = kind.elementType
        if isinstance(item, SCALARS):
            text = vector(c, item, pattern)
        elif isinstance(item, T.StructType):
            text = _list(F.transform(c, lambda x: F.coalesce(nested_object(x, item, pattern), F.lit(EMPTY))))
        else:
            text = _list(F.transform(c, lambda x: value_json(x, item, pattern)))
    elif isinstance(kind, T.StructType):
        text = F.when(c.isNotNull(), _object([(f.name, value_json(c.getField(f.name), f.dataType, pattern)) for f in kind.fields]))
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.cast("string").alias("k"), F.try_element_at(c, k).alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(json_string(e["k"]), F.lit(":"), value_json(e["v"], kind.valueType, pattern))), ","), F.lit("}"))
    else:
        text = F.lit(EMPTY)
    return F.coalesce(text, F.lit(EMPTY))
