"""Text of Python values, by the rules of lists and vectors. Plain Python, so that tasks can use it, too."""

from __future__ import annotations

import datetime
import math
import sys
from collections.abc import Mapping

from pyspark import cloudpickle

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def json_key(name: str) -> str:
    """A key with its colon, as a plain string: keys are known when the plan is built."""
    escaped = "".join(f"\\u{ord(ch):04X}" if ord(ch) < 32 else {'"': '\\"', "\\": "\\\\"}.get(ch, ch) for ch in name)
    return f'"{escaped}":'


def _shortest(x: float) -> str:
    digits = repr(abs(x))
    mantissa, _, power = digits.partition("e")
    if 1e-5 <= abs(x) < 1e16 or x == 0:
        if power:
            digits = f"{abs(x):.{len(mantissa.replace('.', '').rstrip('0') or '0') - 1 - int(power)}f}" if int(power) < 0 else f"{abs(x):.1f}"
        text = digits if "." in digits else digits + ".0"
    else:
        if not power:
            mantissa, _, power = f"{abs(x):.17e}".partition("e")
            mantissa = next(m for m in (f"{abs(x):.{k}e}".partition("e")[0] for k in range(18)) if float(f"{m}e{power}") == abs(x))
        text = f"{mantissa.removesuffix('.0')}e{int(power)}"
    return ("-" if math.copysign(1, x) < 0 else "") + text


def _scalar(x) -> str:
    if x is None:
        return '"NA"'
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        if math.isnan(x):
            return '"NaN"'
        if math.isinf(x):
            return '"Inf"' if x > 0 else '"-Inf"'
        return str(int(x)) if x == int(x) and INT_MIN <= x <= INT_MAX else _shortest(x)
    if isinstance(x, datetime.datetime):
        x = x.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(x, datetime.date):
        x = x.isoformat()
    return json_key(str(x))[:-1]


def local_json(x) -> str:
    """Text of a Python value: single values are vectors of one, sequences of single values of one kind vectors, other
    sequences and mappings lists. None is an object by itself, and a missing value within a list."""
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None:
        return "{}"
    if isinstance(x, Mapping):
        return "{" + ",".join(json_key(str(k)) + ('["NA"]' if v is None else local_json(v)) for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        kinds = {bool if isinstance(v, bool) else float if isinstance(v, (int, float)) else str if isinstance(v, str) else datetime.date if isinstance(v, datetime.date) else None for v in x if v is not None}
        single = None not in kinds and len(kinds) <= 1
        return "[" + ",".join(_scalar(v) if single else '["NA"]' if v is None else local_json(v) for v in x) + "]"
    if isinstance(x, (bool, int, float, str, datetime.date)):
        return f"[{_scalar(x)}]"
    return "{}"


# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
