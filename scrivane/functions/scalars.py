"""Text of single values. Each function builds a Column; nothing is evaluated in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivane.functions.local import INT_MAX, INT_MIN

FULL_TIMESTAMP, DATE_ONLY, NO_SECONDS = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.DoubleType, T.FloatType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
TEXTS = (T.StringType, T.CharType, T.VarcharType)
SCALARS = (*WHOLE, *FLOATING, *TIMESTAMPS, *TEXTS, T.BooleanType, T.DateType, T.DecimalType, T.DayTimeIntervalType)


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def outlined(c: Column, rare: Callable[[Column], Column]) -> Column:
    """rare(c) as a function of its own, for branches that few rows take.

    Generated methods beyond 8,000 bytes are never compiled by the JVM, and one whole stage is one method. A lambda is
    only called from the generated code, and Spark then splits the projection's other expressions into small methods.
    """
    return F.get(F.transform(F.array(c), rare), F.lit(0))


def json_shortest(c: Column) -> Column:
    """The shortest text that reads back as the same number: plain for 1e-5 <= |x| < 1e16, else with a lower-case exponent."""
    size = F.abs(c)
    return F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), c.cast("string")).otherwise(outlined(c, _seldom_shortest))


def _seldom_shortest(c: Column) -> Column:
    size, text = F.abs(c), c.cast("string")
    digits = F.rtrim(text.cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    power = F.replace(F.lower(text), F.lit(".0e"), F.lit("e"))
    for digits_ in (16, 15, 14):  # of numbers this large, the JVM prints some with more digits than they need
        fewer = F.regexp_replace(F.format_string(f"%.{digits_}e", c), r"\.?0*e\+", "e")
        power = F.when((size >= 1e16) & (fewer.try_cast("double") == c), fewer).otherwise(power)
    return F.when((size >= 1e-5) & (size < 1e16), plain).otherwise(power)


def json_number(c: Column) -> Column:
    """A floating attribute: whole numbers within 32 bits lose their point, all others take the shortest text."""
    whole = (c >= INT_MIN) & (c <= INT_MAX) & (F.rint(c) == c)
    return F.when(whole, c.cast("int").cast("string")).otherwise(json_shortest(c))


def json_whole(c: Column) -> Column:
    return c.cast("string")


def json_bool(c: Column) -> Column:
    return c.cast("string")


def json_string(c: Column) -> Column:
    """A quoted string, but for control characters, which escape_controls replaces once in a whole row's text."""
    inner = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _replaced(c: Column, codes: list[int]) -> Column:
    for k in codes:
        c = F.replace(c, F.lit(chr(k)), F.lit(f"\\u{k:04X}"))
    return c


CONTROL = "[\\x00-\\x1F]"


def escape_controls(c: Column, found: Column | None = None) -> Column:
    """Control characters of a finished text as \\u00XX: those of plain text first, the rare others only where there are any.

    found: whether there are any, if that can be told from less than the whole text.
    """
    common = [9, 10, 13]
    rest = [k for k in range(32) if k not in common]
    rare = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
    return F.when(~(c.rlike(CONTROL) if found is None else found), c).when(c.rlike(rare), outlined(c, lambda x: _replaced(x, common + rest))).otherwise(_replaced(c, common))


def json_date(c: Column) -> Column:
    return json_string(F.date_format(c, DATE_ONLY))


def json_timestamp(c: Column, pattern: str = FULL_TIMESTAMP) -> Column:
    return json_string(F.date_format(c, pattern))


def factor_level(code: Column, levels: list[str | None]) -> Column:
    """A factor's level by its code from 1; null for other codes. A null level is the text NA."""
    return F.try_element_at(F.array(*(F.lit("NA" if x is None else x) for x in levels)), F.when(code > 0, code.cast("int")))


def scalar_text(c: Column, kind: T.DataType, pattern: str = FULL_TIMESTAMP) -> Column | None:
    """The text of a present, finite value; null for null. None for kinds that have no text."""
    if isinstance(kind, WHOLE):
        return json_whole(c)
    if isinstance(kind, FLOATING):
        return json_number(c)
    if isinstance(kind, T.BooleanType):
        return json_bool(c)
    if isinstance(kind, TEXTS):
        return json_string(c)
    if isinstance(kind, T.DateType):
        return json_date(c)
    if isinstance(kind, TIMESTAMPS):
        return json_timestamp(c, pattern)
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    if isinstance(kind, T.DayTimeIntervalType):
        return json_number(F.unix_micros(F.timestamp_micros(F.lit(0)) + c) / 1e6)
    return None
