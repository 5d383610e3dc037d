"""Arrays of one simple value, replaced by the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A string outside an array of one is matched first, so that brackets within strings are passed over.
PATTERN = rf'(?s)({_STRING})|\[({_STRING}|[^"\[\]{{}},]+)\]'


def unbox(c: Column) -> Column:
    """One pass over a JSON text; what it writes isn't looked at again, so [[5]] becomes [5]."""
    return F.regexp_replace(c, PATTERN, "$1$2")
