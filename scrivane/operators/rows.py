"""One JSON object for each row of a table, or one feature for each row of a spatial table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivane.functions.geometry import KINDS, geometry_json
from scrivane.functions.local import json_key
from scrivane.functions.scalars import CONTROL, DATE_ONLY, FLOATING, FULL_TIMESTAMP, NO_SECONDS, SCALARS, TEXTS, TIMESTAMPS, escape_controls, is_finite, json_string
from scrivane.functions.unbox import unbox
from scrivane.functions.values import cell, matrix_cell


def named(name: str) -> Column:
    """A column by its very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _plain(names: list[str]) -> None:
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"column names must be unique: {', '.join(twice)}")


def timestamp_patterns(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """For each timestamp column the shortest of three patterns that loses nothing of any value: date, minutes, seconds. One aggregate."""
    columns = list(columns)
    if not columns:
        return {}
    tests = [F.max(F.date_trunc(unit, named(c)) != F.date_trunc("second", named(c))) for c in columns for unit in ("day", "minute")]
    got = df.agg(*(t.alias(str(k)) for k, t in enumerate(tests))).first()
    return {c: FULL_TIMESTAMP if got[2 * k + 1] else NO_SECONDS if got[2 * k] else DATE_ONLY for k, c in enumerate(columns)}


def properties(df: DataFrame, *, leave_out: Iterable[str] = (), row_name_col: str | None = None, matrix_cols: Iterable[str] = (), timestamp_format: str = "auto") -> Column:
    """The object of a row's present cells, before control characters are escaped."""
    _plain(df.columns)
    leave_out, matrix_cols = {*leave_out, *([row_name_col] if row_name_col else [])}, set(matrix_cols)
    fields = [f for f in df.schema.fields if f.name not in leave_out]
    stamps = [f.name for f in fields if isinstance(f.dataType, TIMESTAMPS)]
    patterns = timestamp_patterns(df, stamps) if timestamp_format == "auto" and not df.isStreaming else dict.fromkeys(stamps, FULL_TIMESTAMP if timestamp_format == "auto" else timestamp_format)
    if timestamp_format == "auto" and df.isStreaming and stamps:
        raise ValueError("a stream has no last row: name a timestamp_format")
    pairs = []
    for f in fields:
        pattern = patterns.get(f.name, FULL_TIMESTAMP)
        text = matrix_cell(named(f.name), f.dataType, pattern) if f.name in matrix_cols else cell(named(f.name), f.dataType, pattern)
        if text is not None:
            pairs.append(F.concat(F.lit(json_key(f.name)), text))
    if row_name_col:
        pairs.append(F.concat(F.lit(json_key("_row")), json_string(named(row_name_col).cast("string"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("{}")


def _has_controls(df: DataFrame, leave_out: set[str]) -> Column | None:
    """Whether a row's strings hold control characters; None if only its finished text can tell."""
    fields = [f for f in df.schema.fields if f.name not in leave_out]
    if any(not isinstance(f.dataType, SCALARS) for f in fields):
        return None
    found = F.lit(False)
    for f in fields:
        if isinstance(f.dataType, TEXTS):
            found = found | F.coalesce(named(f.name).rlike(CONTROL), F.lit(False))
    return found


def _finished(df: DataFrame, text: Column, keep: Iterable[str | Column], auto_unbox: bool, alias: str, leave_out: set[str]) -> DataFrame:
    """Escapes once a row, in a projection of its own, so that the row's expression is evaluated once."""
    keep = [named(k) if isinstance(k, str) else k for k in keep]
    found = _has_controls(df, leave_out)
    first = df.select(*(k.alias(f"_k{i}") for i, k in enumerate(keep)), text.alias("_text"), *([] if found is None else [found.alias("_found")]))
    names = df.select(*keep).columns if keep else []
    done = escape_controls(F.col("_text"), None if found is None else F.col("_found"))
    return first.select(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(names)), (unbox(done) if auto_unbox else done).alias(alias))


def row_json(df: DataFrame, *, keep: Iterable[str | Column] = (), auto_unbox: bool = False, alias: str = "json", mode: str = "exact", **options) -> DataFrame:
    """The columns in keep, and each row as a JSON object. Rows stay where they are: no shuffle.

    mode fast uses Spark's own writer, which is valid JSON with other number and escape texts; of the options it has
    leave_out only. options: row_name_col (a
    trailing _row), matrix_cols (arrays that are rows of a matrix), leave_out, timestamp_format (auto: the
    shortest pattern that fits the whole column, by one more pass over the timestamps).
    """
    if mode not in ("exact", "fast"):
        raise ValueError(f"mode is exact or fast, not {mode}")
    if mode == "fast":
        if rest := sorted({*options, *(["auto_unbox"] if auto_unbox else [])} - {"leave_out"}):
            raise ValueError(f"mode fast has no {', '.join(rest)}")
        fields = [F.when(is_finite(named(f.name)), named(f.name)).alias(f.name) if isinstance(f.dataType, FLOATING) else named(f.name) for f in df.schema.fields if f.name not in set(options.get("leave_out", ()))]
        return df.select(*keep, F.to_json(F.struct(*fields)).alias(alias))
    return _finished(df, properties(df, **options), keep, auto_unbox, alias, set(options.get("leave_out", ())))


def feature_json(df: DataFrame, geom_col: str, *, keep: Iterable[str | Column] = (), kinds: Iterable[str] = KINDS, auto_unbox: bool = False, alias: str = "json", **options) -> DataFrame:
    """Each row as a GeoJSON feature: all columns but the geometry are its properties."""
    check_geometry(df, geom_col)
    leave_out = {geom_col, *options.pop("leave_out", ())}
    body = properties(df, leave_out=leave_out, **options)
    text = F.concat(F.lit('{"type":"Feature","properties":'), body, F.lit(',"geometry":'), geometry_json(named(geom_col), kinds), F.lit("}"))
    return _finished(df, text, keep, auto_unbox, alias, leave_out)


def check_geometry(df: DataFrame, geom_col: str) -> None:
    if geom_col not in df.columns:
        raise ValueError(f"Not a spatial table (no column {geom_col})")
    kind = df.schema[geom_col].dataType
    if not isinstance(kind, T.StructType) or kind.fieldNames() != ["kind", "parts"]:
        raise TypeError(f"Not a spatial table ({geom_col} is no geometry)")
