"""Blank checks, millisecond timestamps, durations and text order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that counts as blank (a byte order mark does, information separators do not).
BLANK = "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_BLANK_RE = re.compile("[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*")
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
SAFE = 2**53 - 1


def not_blank(col: Column) -> Column:
    """Null is blank."""
    return F.coalesce(col.rlike(f"[^{BLANK}]"), F.lit(False))


def is_blank(text) -> bool:
    return not isinstance(text, str) or _BLANK_RE.fullmatch(text) is not None


def to_ms(ts: Column) -> Column:
    """A timestamp (with or without zone, UTC) as milliseconds, cut."""
    return F.unix_millis(ts.cast("timestamp"))


def iso(ms: Column) -> Column:
    """Milliseconds as canonical ISO text."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def add_ms(iso_text: Column, ms: int) -> Column:
    return iso(F.unix_millis(F.to_timestamp(iso_text)) + ms)


def is_iso(col: Column) -> Column:
    """Canonical ISO text: exactly milliseconds and Z, and a real instant."""
    return F.coalesce(col.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$") & (iso(F.unix_millis(F.try_to_timestamp(col))) == col), F.lit(False))


def positive(value, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= SAFE:
        raise ValueError(f"{what} must be a positive safe integer")
    return value


def duration_ms(value: int | str) -> int:
    """Milliseconds from an integer or `<number>ms|s|m|h|d`; a product that is no whole number is rejected."""
    if isinstance(value, int) and not isinstance(value, bool):
        return positive(value, "duration")
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d)", value) if isinstance(value, str) else None
    if not m:
        raise ValueError(f"not a duration: {value!r}")
    product = float(m[1]) * UNITS[m[2]]
    if product != int(product):
        raise ValueError(f"not whole milliseconds: {value!r}")
    return positive(int(product), "duration")


def utf16(col: Column) -> Column:
    """Sorts as text in UTF-16 code units."""
    return F.encode(col, "UTF-16BE")
