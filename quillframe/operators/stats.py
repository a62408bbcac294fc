"""Column summaries: one aggregate over all columns, combined on the map side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.scalars import classify, is_numeric, number


def unpivoted(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, field of all cells."""
    columns = list(columns or df.columns)
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("field")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def column_apply(df: DataFrame, columns: Sequence[str] | None = None, **aggregates: Column) -> DataFrame:
    """The same aggregates (over `field`) of every column: column and a column for each aggregate. Partial aggregates combine as they come."""
    return unpivoted(df, columns).groupBy("column").agg(*[a.alias(n) for n, a in aggregates.items()])


def chunk_apply(df: DataFrame, chunk: int, start: Callable, step: Callable, merge: Callable, finish: Callable, schema: str) -> DataFrame:
    """A user aggregate that no built-in expresses: start() makes a state, step(state, pandas chunk) folds a chunk of at most `chunk` rows in,
    merge(state, state) joins two, finish(state) gives the result's rows as a pandas frame. States are pickled, one a partition, and
    meet in one task.
    """
    if chunk < 1:
        raise ValueError("chunk must be positive")
    import pickle

    import pandas as pd

    def partial(batches):
        state = start()
        for b in batches:
            for k in range(0, len(b), chunk):
                state = step(state, b.iloc[k : k + chunk])
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def final(batches):
        state = None
        for b in batches:
            for x in b["state"]:
                other = pickle.loads(bytes(x))
                state = other if state is None else merge(state, other)
        yield finish(start() if state is None else state)

    return df.mapInPandas(partial, "state binary").repartition(1).mapInPandas(final, schema)


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n, mean, variance (sample), min, max of the numeric fields."""
    x = F.col("x")
    cells = unpivoted(df, columns).select("column", number(F.col("field")).alias("x"))
    return cells.groupBy("column").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"))


def eda_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_rows, n_nulls, n_numeric, mean, stdev (0 below two numbers). Bools are no numbers."""
    field = F.col("field")
    x = F.when(is_numeric(F.col("kind")), number(field))
    cells = unpivoted(df, columns).withColumn("kind", classify(field))
    return cells.groupBy("column").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("kind") == 0).alias("n_nulls"), F.count(x).alias("n_numeric"),
        F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """value, count of the n commonest values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def top_values_approx(df: DataFrame, column: str, n: int = 10, tracked: int = 1024) -> DataFrame:
    """value, count of about the n commonest values, from a sketch of at most `tracked` values a task."""
    found = df.agg(F.expr(f"approx_top_k(`{column}`, {n}, {tracked})").alias("top"))
    return found.select(F.inline("top")).toDF("value", "count")


def max_column(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(number(F.col(column))).alias("max"))


def etl_multi_pass(df: DataFrame, group: str, amount: str, quantity: str, flag: str, flag_value: str) -> DataFrame:
    """group, n, amount (decimal), quantity, flagged: all passes of the load benchmark as one aggregate."""
    exact = lambda c: F.col(c).try_cast("decimal(18,2)")
    return df.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"), F.sum(exact(amount)).alias("amount"), F.sum(exact(quantity)).alias("quantity"), F.count_if(F.col(flag) == flag_value).alias("flagged")
    )
