"""Tables to rows, features and documents."""

from scrivane.operators.documents import as_json, to_geojson, to_json_array
from scrivane.operators.rows import feature_json, row_json

__all__ = ["as_json", "feature_json", "row_json", "to_geojson", "to_json_array"]
