"""Encoding of streams: rows and features one by one, documents for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from scrivane.functions.scalars import FULL_TIMESTAMP
from scrivane.operators.documents import to_geojson, to_json_array
from scrivane.operators.rows import feature_json, row_json


def stream_rows(df: DataFrame, geom_col: str | None = None, timestamp_format: str = FULL_TIMESTAMP, **options) -> DataFrame:
    """A stream's rows as objects, or features. The encoders keep no state, so any output mode and trigger will do."""
    if geom_col:
        return feature_json(df, geom_col, timestamp_format=timestamp_format, **options)
    return row_json(df, timestamp_format=timestamp_format, **options)


def document_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], geom_col: str | None = None, order_by=None, timestamp_format: str = FULL_TIMESTAMP, **options) -> DataStreamWriter:
    """A writer that gives sink one document for each micro-batch, as a one-row DataFrame, with the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        own = {"timestamp_format": timestamp_format, **options}
        sink(to_geojson(batch, geom_col, order_by, **own) if geom_col else to_json_array(batch, order_by, **own), number)

    return df.writeStream.foreachBatch(each)
