"""The text rules in plain Python, for comparison."""

import math


def escape(s: str) -> str:
    return '"' + "".join(f"\\u{ord(c):04X}" if ord(c) < 32 else "\\" + c if c in '"\\' else c for c in s) + '"'


def shortest(x: float) -> str:
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    mantissa, _, power = f"{x:.16e}".partition("e")
    for k in range(17):
        mantissa, _, power = f"{x:.{k}e}".partition("e")
        if float(f"{mantissa}e{power}") == x:
            break
    digits, e = mantissa.lstrip("-").replace(".", "").rstrip("0") or "0", int(power)
    sign = "-" if x < 0 else ""
    if 1e-5 <= abs(x) < 1e16:
        if e < 0:
            return f"{sign}0.{'0' * (-e - 1)}{digits}"
        return f"{sign}{digits[: e + 1].ljust(e + 1, '0')}.{digits[e + 1 :] or '0'}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{e}"


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and -(2**31) <= x <= 2**31 - 1 else shortest(x)


def unbox(text: str) -> str:
    """One pass; strings are copied, arrays of one simple value lose their brackets."""
    out, k = [], 0

    def string_end(i: int) -> int:
        i += 1
        while text[i] != '"':
            i += 2 if text[i] == "\\" else 1
        return i + 1

    while k < len(text):
        if text[k] == '"':
            e = string_end(k)
            out.append(text[k:e])
            k = e
        elif text[k] == "[":
            if text[k + 1] == '"':
                e = string_end(k + 1)
            else:
                e = k + 1
                while text[e] not in '"[]{},':
                    e += 1
            if e > k + 1 and text[e] == "]":
                out.append(text[k + 1 : e])
                k = e + 1
            else:
                out.append("[")
                k += 1
        else:
            out.append(text[k])
            k += 1
    return "".join(out)
