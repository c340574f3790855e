"""Canonical JSON: one text for one value. Python for values in hand, Column expressions for typed columns."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from functools import lru_cache
from json.encoder import encode_basestring

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exp = repr(x).partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exp or 0)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0")
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    e = point - 1
    return sign + all_digits[0] + ("." + all_digits[1:] if n > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))


@lru_cache(4096)
def _order(key: str) -> tuple:
    """Integer-like keys first by number, then UTF-16 code units."""
    if re.fullmatch(r"0|[1-9]\d{0,9}", key) and int(key) < 2**32 - 1:
        return 0, int(key), b""
    return 1, 0, key.encode("utf-16-be", "surrogatepass")


def canonical_json(value) -> str:
    """Canonical text of None, bool, int, float, str, list and dict; anything else, and cycles, raise TypeError or ValueError."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        text = encode_basestring(value)
        return text if text.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)
    if isinstance(value, int):
        return _number(float(value)) if abs(value) > 2**53 - 1 else str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("object keys must be strings")
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value, key=_order)) + "}"
    raise TypeError(f"not a JSON value: {type(value).__name__}")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def value_bytes(value) -> int:
    """UTF-8 length of a value's canonical text."""
    return len(canonical_json(value).encode("utf-8", "surrogatepass"))


def _once(value: Column, f) -> Column:
    """f(value) with the value's expression in the plan once, however often f names it: plans of nested keys stay small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _low_escapes(json_text: Column) -> Column:
    """Spark writes control characters with upper-case hex digits; canonical text has lower case."""
    def lowered(text: Column, digit: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\u00([01])"), digit), F.concat(F.lit(r"$1\\u00$2"), F.lower(digit)))

    return F.when(json_text.contains("\\u00"), F.aggregate(F.split(F.lit("ABCDEF"), ""), json_text, lowered)).otherwise(json_text)


def array_json(parts: Iterable[Column]) -> Column:
    """Canonical text of an array of strings; a null element is JSON null."""
    return _once(F.to_json(F.array(*[p.cast("string") for p in parts])), _low_escapes)


def string_json(col: Column) -> Column:
    """Canonical text of a string column; null stays null."""
    return _once(F.to_json(F.array(col.cast("string"))), lambda j: F.when(j != "[null]", F.substring(_low_escapes(j), F.lit(2), F.length(j) - 2)))


def plain_json(text: Column) -> Column:
    """Canonical text of a string that needs no escapes, such as a time; null stays null."""
    return F.concat(F.lit('"'), text, F.lit('"'))


def object_json(fields: dict[str, Column]) -> Column:
    """Canonical text of an object whose fields are given as JSON texts; a null text means that the field is absent."""
    parts = [F.concat(F.lit(canonical_json(k) + ":"), fields[k]) for k in sorted(fields, key=_order)]  # null if the field is
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
