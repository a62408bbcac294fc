"""Rows made up for loads and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, rows: int, columns: int = 5, seed: int = 1, distinct: bool = False) -> DataFrame:
    """`rows` rows of integer columns col_A, col_B, ...: random below a million, or distinct (columns * row + column)."""
    name = lambda k: f"col_{chr(65 + k)}" if k < 26 else f"col_{k}"
    value = (lambda k: F.col("id") * columns + k) if distinct else (lambda k: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1_000_000)))
    return spark.range(rows).select(*[value(k).alias(name(k)) for k in range(columns)])
