"""Delimited files as they arrive: the rows of the batch reader, on a stream, and work on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from quillframe.operators import infer
from quillframe.sources import dialect as d
from quillframe.sources.delimited import Rows, fast_options, string_schema, trim_fields


def stream(spark: SparkSession, folder: str, names: Sequence[str], dialect: d.Dialect | None = None, multiline: bool = True, max_files: int | None = None) -> Rows:
    """Rows of the files that arrive in a folder. The dialect must be settled: one delimiter, a header in record 0 or none, the default ragged policy."""
    dialect = dialect or d.Dialect()
    if dialect.ragged != d.IGNORE_ROW and dialect.header != -1 or (dialect.header or 0) > 0:
        raise d.DialectError("a stream drops ragged rows and has its header in the first record or none")
    r = d.Resolved(dialect, dialect.delimiter, -1 if dialect.header is None else dialect.header, tuple(names), len(names))
    source = spark.readStream.options(**fast_options(r), multiLine=str(multiline).lower()).schema(string_schema(r.width))
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    return Rows(trim_fields(source.csv(folder), r.width, dialect.trim), tuple(names), dialect.name_policy)


def for_each_chunk(rows: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """f(frame, batch number) for each micro-batch: what a bounded-memory pull of chunks is on a batch source."""
    return rows.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint)


def typed_chunks(rows: DataFrame, f: Callable[[DataFrame, dict[str, str], int], None], checkpoint: str) -> DataStreamWriter:
    """As for_each_chunk, with the frame cast to the dtypes that its own rows fit."""

    def typed(frame: DataFrame, number: int) -> None:
        plan = infer.dtypes(frame)
        f(infer.cast_to(frame, plan), plan, number)

    return for_each_chunk(rows, typed, checkpoint)
