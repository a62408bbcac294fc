"""Rows as JSON text. Fields of a numeric class are written as they stand, all others as strings, in the order asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.scalars import classify, is_numeric

_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_escape(text: Column) -> Column:
    """Text as the inside of a JSON string: quotes, backslashes and controls escaped."""
    for c, e in _SHORT.items():
        text = F.replace(text, F.lit(c), F.lit(e))
    for k in (k for k in range(32) if chr(k) not in _SHORT):
        text = F.replace(text, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return text


def json_value(field: Column, strict: bool = False) -> Column:
    """strict: numbers that JSON doesn't know (hex, a plus sign, a bare point, leading zeros) are strings too."""
    x = F.coalesce(field, F.lit(""))
    raw = is_numeric(classify(x))
    if strict:
        raw = raw & x.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
    return F.when(raw, x).otherwise(F.concat(F.lit('"'), json_escape(x), F.lit('"')))


def _key(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def row_json(names: Sequence[str], fields: Sequence[Column], strict: bool = False) -> Column:
    """{"name":value,...} of the shorter of names and fields."""
    parts = []
    for k, (n, f) in enumerate(zip(names, fields, strict=False)):
        parts += [F.lit(("," if k else "") + _key(n) + ":"), json_value(f, strict)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def row_json_array(fields: Sequence[Column], strict: bool = False) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[json_value(f, strict) for f in fields]), F.lit("]"))
