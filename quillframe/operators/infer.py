"""Types of columns inferred from their fields: sound ones, those of two older inferences, SQL DDL, and array dtypes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import scalars as s

INTEGERS = (s.INT8, s.INT16, s.INT32, s.INT64)


def type_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, position, type_id, n: how many fields of each class a column has. One pass, all columns at once."""
    columns = list(columns or df.columns)
    kinds = df.select(*[s.classify(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(columns)])
    long = kinds.select(F.posexplode(F.array(*[F.col(f"`{k}`") for k in range(len(columns))])).alias("position", "type_id"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1)
    return long.groupBy("position", "type_id").agg(F.count("*").alias("n")).select(names.alias("column"), "position", "type_id", "n")


def _has(counts: DataFrame) -> DataFrame:
    wide = counts.groupBy("column", "position")
    return wide.agg(*[F.sum(F.when(F.col("type_id") == k, F.col("n")).otherwise(0)).alias(f"t{k}") for k in s.NAMES])


def _first(*order: int, otherwise: int) -> Column:
    c = F.when(F.lit(False), otherwise)
    for k in order:
        c = c.when(F.col(f"t{k}") > 0, k)
    return c.otherwise(otherwise)


def sound_type() -> Column:
    """The narrowest class that all fields fit, nulls aside."""
    number = F.col("t3") + F.col("t5") + F.col("t7") + F.col("t9") + F.col("t11") + F.col("t12")
    other = F.col("t2") + F.col("t14")
    mixed = (F.col("t1") > 0) | ((number > 0) & (other > 0)) | ((F.col("t2") > 0) & (F.col("t14") > 0))
    return F.when(mixed, s.STRING).when(F.col("t12") > 0, s.DOUBLE).otherwise(_first(s.BIGINT, s.INT64, s.INT32, s.INT16, s.INT8, s.BOOL, s.TIMESTAMP, otherwise=s.NULL))


def data_types(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """column, type_id, type of each column over all rows.

    compat: the older order of precedence, by which integers outrank doubles and any null outranks a double.
    """
    old = _first(s.STRING, s.INT64, s.INT32, s.INT16, s.INT8, s.BOOL, s.TIMESTAMP, s.NULL, otherwise=s.DOUBLE)
    found = _has(type_counts(df, columns)).select("column", (old if compat else sound_type()).cast("int").alias("type_id"))
    return found.withColumn("type", _name("type_id"))


def _name(column: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in s.NAMES.items() for x in kv]), F.col(column))


#: SQL types by class.
SQL_TYPES = {s.NULL: "TEXT", s.STRING: "TEXT", s.BOOL: "BOOLEAN", s.INT8: "SMALLINT", s.INT16: "SMALLINT", s.INT32: "INTEGER", s.INT64: "BIGINT", s.BIGINT: "NUMERIC", s.DOUBLE: "DOUBLE PRECISION", s.TIMESTAMP: "TIMESTAMP"}


def schema_info(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """column, position, rows, nulls, nullable, type_id, sql_type, and the two commonest classes (count falling, then class)."""
    counts = type_counts(df, columns)
    order = Window.partitionBy("position").orderBy(F.desc("n"), "type_id")  # at most a row a class
    top = counts.withColumn("_r", F.row_number().over(order)).groupBy("position").agg(
        F.max(F.when(F.col("_r") == 1, F.col("type_id"))).alias("top1"), F.max(F.when(F.col("_r") == 2, F.col("type_id"))).alias("top2")
    )
    old = _first(s.STRING, s.INT64, s.INT32, s.INT16, s.INT8, s.BOOL, s.TIMESTAMP, s.DOUBLE, s.NULL, otherwise=s.STRING)
    total = sum((F.col(f"t{k}") for k in s.NAMES), F.lit(0))
    info = _has(counts).select("column", "position", total.alias("rows"), F.col("t0").alias("nulls"), (F.col("t0") > 0).alias("nullable"), (old if compat else sound_type()).cast("int").alias("type_id"))
    info = info.withColumn("sql_type", F.element_at(F.create_map(*[F.lit(x) for kv in SQL_TYPES.items() for x in kv]), F.col("type_id")))
    return info.join(top, "position")


def ddl(df: DataFrame, table: str, columns: Sequence[str] | None = None, compat: bool = False) -> str:
    """CREATE TABLE for the columns; the driver sees a row a column."""
    rows = schema_info(df, columns, compat).orderBy("position").collect()
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    return f"CREATE TABLE {quote(table)} (\n" + ",\n".join(f"    {quote(r['column'])} {r['sql_type']}{'' if r['nullable'] else ' NOT NULL'}" for r in rows) + "\n);"


# --- array dtypes ---------------------------------------------------------------------------------------------------------------

SAMPLE, GLOBAL, BATCH = "sample", "global", "batch"


def dtypes(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """string, int64, float64 or bool of each column.

    Integers and floats are float64, any other mix a string; integers and bools with nulls are float64, as are columns of nulls;
    integers beyond 64 bits and timestamps are strings.
    """
    out = {}
    for r in _has(type_counts(df, columns)).collect():  # a row a column
        n = {k: r[f"t{k}"] for k in s.NAMES}
        ints = sum(n[k] for k in INTEGERS)
        text = n[s.STRING] + n[s.BIGINT] + n[s.TIMESTAMP]
        if text or (n[s.BOOL] and (ints or n[s.DOUBLE])):
            out[r["column"]] = "string"
        elif n[s.DOUBLE] or n[s.NULL] or not (ints or n[s.BOOL]):
            out[r["column"]] = "float64"
        else:
            out[r["column"]] = "int64" if ints else "bool"
    return {c: out.get(c, "float64") for c in (columns or df.columns)}


def cast_to(df: DataFrame, plan: Mapping[str, str]) -> DataFrame:
    """Columns cast by a plan of dtypes. What doesn't fit a fixed plan becomes 0, false or null, as count_coerced tells."""
    cast = {
        "string": lambda c: F.coalesce(c, F.lit("")),
        "int64": lambda c: F.coalesce(s.try_get(c, "int64"), F.lit(0).cast("long")),
        "float64": lambda c: F.coalesce(s.number(c), s.boolean(c).cast("double")),
        "bool": lambda c: F.coalesce(s.boolean(c), F.lit(False)),
    }
    return df.select(*[cast[t](F.col(f"`{c}`")).alias(c) for c, t in plan.items()])


def count_coerced(df: DataFrame, plan: Mapping[str, str]) -> DataFrame:
    """One row: for each column how many fields a plan can't hold."""
    bad = {
        "string": lambda c: F.lit(False),
        "int64": lambda c: ~s.classify(c).isin(*INTEGERS),
        "float64": lambda c: s.number(c).isNull() & s.boolean(c).isNull() & (s.classify(c) != s.NULL),
        "bool": lambda c: s.boolean(c).isNull(),
    }
    return df.agg(*[F.count_if(bad[t](F.col(f"`{c}`"))).alias(c) for c, t in plan.items()])
