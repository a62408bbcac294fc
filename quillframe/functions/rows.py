"""Rows as arrays, maps and Python values."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT, _HEX = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?0[xX][0-9A-Fa-f]+")
_DOUBLE = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?")


def row_array(fields: Sequence[Column]) -> Column:
    return F.array(*fields)


def row_slice(fields: Sequence[Column], start: int | None = None, stop: int | None = None) -> Column:
    """Fields from start to stop as Python slices count them, as an array."""
    part = list(fields)[start:stop]
    return F.array(*part) if part else F.array().cast("array<string>")


def row_map(names: Sequence[str], fields: Sequence[Column], subset: Sequence[str] | None = None) -> Column:
    """Name to field; of equal names the last counts. A name of the subset that isn't there raises KeyError."""
    held = dict(zip(names, fields, strict=False))
    if subset is not None:
        for n in subset:
            if n not in held:
                raise KeyError(f"Column not found: {n}")
        held = {n: held[n] for n in subset}
    return F.create_map(*[x for n, f in held.items() for x in (F.lit(n), f)]) if held else F.create_map().cast("map<string,string>")


def python_value(text: str | None):
    """A field as Python sees it: None, bool, int, float, datetime (naive, UTC), else the text; integers beyond 64 bits stay text."""
    x = (text or "").strip(" ")
    if not x.strip():
        return None
    if x.lower() in ("true", "false"):
        return x.lower() == "true"
    if _INT.fullmatch(x) or _HEX.fullmatch(x):
        n = int(x, 16 if "x" in x.lower() else 10)
        return n if -(2**63) <= n < 2**63 else text
    if _DOUBLE.fullmatch(x):
        return float(x)
    if _TIME.fullmatch(x):
        try:
            t = datetime.datetime.fromisoformat(x)
        except ValueError:
            return text
        return t.astimezone(datetime.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    return text
