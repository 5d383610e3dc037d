"""Spark-native encoding of typed, nested and spatial tables into compact JSON and GeoJSON text."""

from scrivane.operators import as_json, feature_json, row_json, to_geojson, to_json_array

__all__ = ["as_json", "feature_json", "row_json", "to_geojson", "to_json_array"]
