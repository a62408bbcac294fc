"""Scalar classes of text fields and conversions with defined errors, as Column expressions.

Classes are numbers: 0 null, 1 string, 2 bool, 3/5/7/9 integers of 8/16/32/64 bits, 11 integers beyond, 12 double, 14 timestamp.

Grammar: outer spaces are ignored but for strings; a field of white space is null; bool is true or false in any case; integers are
decimal with an optional sign, or hex behind 0x; doubles have digits, a point or an exponent (`.5` and `5.` count, nan and inf don't);
timestamps are ISO dates with an optional time, fraction and Z or offset. Nothing else is cast, so Spark's laxer casts don't show.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, STRING, BOOL, INT8, INT16, INT32, INT64, BIGINT, DOUBLE, TIMESTAMP = 0, 1, 2, 3, 5, 7, 9, 11, 12, 14
NAMES = {NULL: "null", STRING: "string", BOOL: "bool", INT8: "int8", INT16: "int16", INT32: "int32", INT64: "int64", BIGINT: "bigint", DOUBLE: "double", TIMESTAMP: "timestamp"}

_INT = r"^[+-]?\d+$"
_HEX = r"^[+-]?0[xX][0-9A-Fa-f]+$"
_DOUBLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"

NOT_A_NUMBER, OVERFLOW, FLOAT_TO_INT, NEGATIVE = "Not a number.", "Overflow error.", "Attempted to convert a floating point value to an integral type.", "Negative numbers cannot be converted to unsigned types."
NOT_A_BOOL, NOT_A_TIME = "Not a boolean.", "Not a timestamp."

WIDTHS = {"int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}


def bare(field: Column) -> Column:
    return F.trim(field)


def hex_value(text: Column) -> Column:
    """The value of hex digits without prefix, as decimal(20,0); null for other text or more than 16 significant digits."""
    digits = F.regexp_replace(F.upper(text), "^0+(?=.)", "")
    return F.when(text.rlike("^[0-9A-Fa-f]+$") & (F.length(digits) <= 16), F.conv(digits, 16, 10).cast("decimal(20,0)"))


def integer_value(field: Column) -> Column:
    """The integer that a field spells, as decimal(38,0); null where it spells none or one of more than 38 digits."""
    x = bare(field)
    unsigned = F.regexp_replace(x, "^[+-]", "")
    hexed = hex_value(F.substring(unsigned, 3, 1_000_000)).cast("decimal(38,0)")
    sign = F.when(x.startswith("-"), F.lit(-1).cast("decimal(1,0)")).otherwise(F.lit(1).cast("decimal(1,0)"))
    return F.when(x.rlike(_INT), x.try_cast("decimal(38,0)")).when(x.rlike(_HEX), (hexed * sign).cast("decimal(38,0)"))


def _width(x: Column) -> Column:
    """The class of an integer by its bits, in one expression over its value, so that the generated code stays small."""
    digits = F.regexp_replace(x, "^[+-]?0[xX]0*(?=.)", "")
    value = F.when(x.rlike(_HEX), F.concat(F.when(x.startswith("-"), "-").otherwise(""), F.conv(F.when(F.length(digits) <= 16, digits).otherwise("FFFFFFFFFFFFFFFF"), 16, 10))).otherwise(x).try_cast("bigint")
    bits = F.length(F.bin(value.bitwiseXOR(F.shiftright(value, 63))))  # 1 to 63
    steps = F.length(F.bin(bits.cast("long")))  # up to 3 for 7 bits, 4 for 15, 5 for 31, 6 for 63
    return F.coalesce(F.when(steps > 3, 2 * steps - 3).when(steps <= 3, INT8), F.lit(BIGINT))


def classify(field: Column) -> Column:
    """The class of a field, as an int. Null counts as an empty field."""
    x = bare(F.coalesce(field, F.lit("")))
    return (
        F.when(x.rlike(_INT) | x.rlike(_HEX), _width(x))
        .when(x.rlike(_DOUBLE), DOUBLE)
        .when(x.rlike(r"^\s*$"), NULL)
        .when(F.lower(x).isin("true", "false"), BOOL)
        .when(x.rlike(_TIME) & x.try_cast("timestamp").isNotNull(), TIMESTAMP)
        .otherwise(STRING)
        .cast("int")
    )


def is_numeric(kind: Column) -> Column:
    return kind.between(INT8, DOUBLE)


def number(field: Column) -> Column:
    """Double of any field of a numeric class, else null."""
    x = bare(field)
    return F.when(x.rlike(_DOUBLE), x.try_cast("double")).when(x.rlike(_HEX), integer_value(x).cast("double"))


def boolean(field: Column) -> Column:
    x = F.lower(bare(field))
    return F.when(x == "true", True).when(x == "false", False)


def timestamp_millis(field: Column) -> Column:
    """Milliseconds since 1970 of a timestamp field; a non-negative integer passes as it is; else null. Zoneless times are UTC in a UTC session."""
    x = bare(field)
    n = integer_value(x)
    return F.when(x.rlike(_TIME), F.unix_millis(x.try_cast("timestamp"))).when(n.between(F.lit(0), F.lit(2**63 - 1)), n.cast("long"))


def timestamp_seconds(field: Column) -> Column:
    """Whole seconds since 1970 of a timestamp field, truncated."""
    return F.floor(timestamp_millis(field) / 1000)


def _exact(kind: str) -> str:
    return {"int8": "byte", "int16": "short", "int32": "int", "int64": "long", "uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)"}[kind]


def convert(field: Column, kind: str) -> Column:
    """struct(value, error) of a field as `kind`: string, bool, double, timestamp, a width of int or uint. error is null where value is right.

    Errors go in this order: not a number, beyond 64 bits, a fraction, a negative number for an unsigned kind, beyond the width.
    """
    x = F.coalesce(field, F.lit(""))
    if kind == "string":
        return F.struct(x.alias("value"), F.lit(None).cast("string").alias("error"))
    if kind == "bool":
        return F.struct(boolean(x).alias("value"), F.when(boolean(x).isNull(), NOT_A_BOOL).alias("error"))
    if kind == "timestamp":
        ms = timestamp_millis(x)
        return F.struct(F.timestamp_millis(ms).alias("value"), F.when(ms.isNull(), NOT_A_TIME).alias("error"))
    group = classify(x)
    error = F.when(~is_numeric(group), NOT_A_NUMBER).when(group == BIGINT, OVERFLOW)
    if kind == "double":
        return F.struct(F.when(error.isNull(), number(x)).alias("value"), error.alias("error"))
    low, high = WIDTHS[kind]
    value = integer_value(x)
    error = error.when(group == DOUBLE, FLOAT_TO_INT)
    if kind.startswith("u"):
        error = error.when(value < 0, NEGATIVE)
    error = error.when(~value.between(F.lit(low), F.lit(high)), OVERFLOW)
    return F.struct(F.when(error.isNull(), value).cast(_exact(kind)).alias("value"), error.alias("error"))


def get(field: Column, kind: str) -> Column:
    """The value, or the query fails with the conversion's message."""
    c = convert(field, kind)
    return F.when(c["error"].isNull(), c["value"]).otherwise(F.raise_error(c["error"]))


def try_get(field: Column, kind: str) -> Column:
    return convert(field, kind)["value"]


def parse_hex(field: Column, kind: str = "int64") -> Column:
    """Hex with or without 0x, outer spaces ignored, null where it isn't hex or doesn't fit the width."""
    x = F.regexp_replace(bare(field), "^(-?)0[xX]", "$1")
    v = hex_value(F.regexp_replace(x, "^-", ""))
    v = F.when(x.startswith("-"), -v).otherwise(v)
    return F.when(v.between(*[F.lit(b) for b in WIDTHS[kind]]), v).cast(_exact(kind))


def parse_decimal(field: Column, symbol: str = ",") -> Column:
    """Double of text with another decimal symbol; integers pass; a point is then no decimal symbol."""
    x = bare(field)
    other = symbol != "."
    changed = F.translate(x, symbol, ".") if other else x
    return F.when(~(F.lit(other) & x.contains(".")) & changed.rlike(_DOUBLE), changed.try_cast("double"))


def fields_equal(field: Column, value) -> Column:
    """Equality with a literal: strings exactly, numbers within 1e-6; integers beyond 64 bits equal no number."""
    if isinstance(value, str):
        return F.coalesce(field, F.lit("")) == value
    return F.coalesce((classify(field) != BIGINT) & (F.abs(number(field) - F.lit(float(value))) < 1e-6), F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lowers A to Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def number_text(value: Column, places: int = 5) -> Column:
    """A number as the writer spells it: `places` decimals, halves away from zero, `.0` where the fraction is zero."""
    x = value.cast("double")
    rounded = F.round(F.abs(x).cast("decimal(38,12)"), places)
    sign = F.when((x < 0) & (rounded != 0), "-").otherwise("")
    whole = F.floor(F.abs(x).cast("decimal(38,12)"))
    fixed = rounded.cast(f"decimal(38,{places})").cast("string")
    plain = F.concat(whole.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    short = F.concat(F.round(rounded, 0).cast("decimal(38,0)").cast("string"), F.lit(".0"))
    carried = (rounded == F.round(rounded, 0)) & (F.lit(places) == 1)
    return F.when(x.isNull(), "").otherwise(F.concat(sign, F.when(F.abs(x) == F.floor(F.abs(x)), plain).when(carried, short).otherwise(fixed)))


#: Text that stands for a missing value.
NULL_WORDS = ("", "null", "n/a", "na", "none")


def null_words_to_empty(field: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(field, F.lit("")))).isin(*NULL_WORDS), "").otherwise(field)
