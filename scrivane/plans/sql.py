"""Pieces of SQL that the queries' twins are put together from."""


def quoted(x: str) -> str:
    text = rf"""replace(replace({x}, '\', '\\'), '"', '\"')"""
    for k in range(1, 32):
        text = rf"replace({text}, chr({k}), '\u{k:04X}')"
    return f"""('"' || {text} || '"')"""


def number(x: str) -> str:
    return f"(CASE WHEN {x} = trunc({x}) AND {x} BETWEEN -2147483648 AND 2147483647 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def shortest(x: str) -> str:
    """A number's shortest text: plain from 1e-5 to 1e16, else with a bare exponent."""
    text, power = f"CAST({x} AS VARCHAR)", rf"regexp_replace(CAST({x} AS VARCHAR), 'e[+]?(-?)0*', 'e\1')"
    plain = f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '0.0000' || replace(split_part(CAST(abs({x}) AS VARCHAR), 'e', 1), '.', ''))"
    return f"(CASE WHEN contains({text}, 'e') THEN CASE WHEN abs({x}) BETWEEN 1e-5 AND 1e-4 THEN {plain} ELSE {power} END ELSE {text} END)"


def shortest_number(x: str) -> str:
    return f"(CASE WHEN {x} = trunc({x}) AND {x} BETWEEN -2147483648 AND 2147483647 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE {shortest(x)} END)"


def whole(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def boolean(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def stamp(x: str, pattern: str = "%Y-%m-%d %H:%M:%S") -> str:
    return f"""('"' || strftime({x}, '{pattern}') || '"')"""


def finite(x: str) -> str:
    return f"(CASE WHEN NOT isnan({x}) AND NOT isinf({x}) THEN {number(x)} END)"


def coordinate(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def entry(key: str, text: str) -> str:
    return f"""'"{key}":' || {text}"""


def row(*pairs: tuple[str, str]) -> str:
    return "('{' || concat_ws(',', " + ", ".join(entry(k, t) for k, t in pairs) + ") || '}')"


def box(text: str) -> str:
    return f"('[' || {text} || ']')"


def vector(items: str, text: str) -> str:
    """items as a vector; text is the SQL of one item, x."""
    return f"""coalesce('[' || array_to_string(list_transform({items}, lambda x: coalesce({text}, '"NA"')), ',') || ']', '{{}}')"""


def vector_number(x: str = "x") -> str:
    return f"""(CASE WHEN isnan({x}) THEN '"NaN"' WHEN {x} = 'inf'::DOUBLE THEN '"Inf"' WHEN {x} = '-inf'::DOUBLE THEN '"-Inf"' ELSE {number(x)} END)"""


UNBOX = r"""regexp_replace({}, '("[^"\\]*(?:\\.[^"\\]*)*")|\[("[^"\\]*(?:\\.[^"\\]*)*"|[^"\[\]{{}},]+)\]', '\1\2', 'g')"""


def unbox(x: str) -> str:
    return UNBOX.format(x)
