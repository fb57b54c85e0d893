"""JSON text on the Python side: strict decoding, canonical text, typed keys.

Canonical text is compact, with keys in byte order and the shortest decimal text of each number.
Types: null, boolean, integer (fits 64 bits, signed or unsigned), number, string, array, object.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from json.encoder import encode_basestring

MAX_DEPTH = 127
INT_LEAST, INT_MOST = -(2**63), 2**64 - 1
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
#: Number texts that Python's own reader or writer would treat otherwise than asked here: -0, 16 digits,
#: 0.0000, exponents.  It may find more than these; one set of first characters lets the search skip ahead.
_ODD = re.compile(r"[-0-9](?:[eE]|(?<=-)0|(?<=0)\.0000|[0-9]{15})")


class JsonError(ValueError):
    """A document that is not JSON."""


def number_text(x: float) -> str:
    """Shortest decimal text: positional between 1e-5 and 1e16, else like ``1.5e20``."""
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    sign, digits, exponent = _decimal(x)
    point = len(digits) + exponent  # digits before the decimal point
    if 0 <= exponent and point <= 16:
        text = digits + "0" * exponent + ".0"
    elif 0 < point <= 16:
        text = digits[:point] + "." + digits[point:]
    elif -5 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1}"
    return sign + text


def _decimal(x: float) -> tuple[str, str, int]:
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0") if part != "0" else whole.lstrip("0")
    exponent = int(exponent or 0) - (len(part) if part != "0" else 0)
    short = digits.rstrip("0")
    return "-" if x < 0 else "", short or "0", exponent + len(digits) - len(short)


def _integer(text: str) -> int | float:
    if text == "-0":
        return -0.0
    if len(text) < 19:
        return int(text)
    if len(text) <= 20 and INT_LEAST <= (value := int(text)) <= INT_MOST:
        return value
    return _float(text)


def _float(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise JsonError("number out of range")
    return value


def _constant(text: str) -> None:
    raise JsonError(f"expected value: {text}")


_plain = json.JSONDecoder(parse_constant=_constant)
_careful = json.JSONDecoder(parse_constant=_constant, parse_int=_integer, parse_float=_float)
_dumps = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode


def decode(text: str) -> tuple[object, bool]:
    """The value, and whether its numbers need ``number_text`` inside containers."""
    odd = _ODD.search(text) is not None
    try:
        return (_careful if odd else _plain).decode(text), odd
    except JsonError:
        raise
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e)) from e


def canonical(value: object, odd: bool = True) -> str:
    if not odd:
        return _dumps(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_basestring(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return number_text(value) if isinstance(value, float) else _dumps(value)


def type_of(value: object) -> str:
    if value is None:
        return "null"
    kind = type(value)
    return "string" if kind is str else "integer" if kind is int else "boolean" if kind is bool else "number" if kind is float else "object" if kind is dict else "array"


def quoted(text: str) -> str:
    return encode_basestring(text)


def debug_text(text: str) -> str:
    """``text`` with quotes, backslashes, non-printing and combining characters escaped."""
    if text.isprintable() and '"' not in text and "\\" not in text and (text.isascii() or not any(unicodedata.category(c) in ("Mn", "Me") for c in text)):
        return text
    short = {"\0": "\\0", "\t": "\\t", "\r": "\\r", "\n": "\\n", '"': '\\"', "\\": "\\\\"}
    return "".join(short.get(c) or (c if c.isprintable() and unicodedata.category(c) not in ("Mn", "Me") else f"\\u{{{ord(c):x}}}") for c in text)


def key_text(kind: str, text: str, container_hash: str = "") -> str:
    """What a value's hash is taken of; ``text``: the raw string, or the canonical text of other types."""
    if kind == "string":
        return f'String("{debug_text(text)}")'
    if kind == "null":
        return "Null"
    if kind == "boolean":
        return f"Bool({text})"
    if kind in ("integer", "number"):
        return f'{kind.capitalize()}("{text}")'
    return f'{kind.capitalize()}Hash("{container_hash}")'
