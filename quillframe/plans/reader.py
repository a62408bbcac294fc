"""The reader façade: a source, its dialect and a predicate make a plan; rows leave as frames, lists, tuples, dicts or batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import scalars
from quillframe.operators import infer
from quillframe.operators.predicates import Predicate, all_of
from quillframe.sources import dialect as d
from quillframe.sources.delimited import Rows, scan
from quillframe.sources.paths import scratch


def typed(field, kind: str):
    """A field as the value of its column's dtype; text where that is string."""
    return {"string": field, "int64": scalars.try_get(field, "int64"), "float64": scalars.number(field), "bool": scalars.boolean(field)}[kind]


@dataclass(frozen=True)
class Reader:
    """A lazy plan. Each method that changes it gives a new one."""

    rows: Rows
    predicate: Predicate | None = None

    @property
    def fieldnames(self) -> list[str]:
        return list(self.rows.names)

    def filter(self, predicate: Predicate, append: bool = True) -> "Reader":
        """Adds a predicate, or replaces what is there. Its columns must exist, by exact name whatever the names' policy."""
        if not isinstance(predicate, Predicate):
            raise TypeError("filter wants a predicate")
        for c in sorted(predicate.columns()):
            if c not in self.rows.names:
                raise KeyError(f"Column not found: {c}")
        return replace(self, predicate=all_of(self.predicate, predicate) if append and self.predicate else predicate)

    def _filtered(self) -> DataFrame:
        first = {n: F.col(f"_c{k}") for k, n in reversed(list(enumerate(self.rows.names)))}  # the first of equal names
        return self.rows.df.filter(self.predicate.condition(first.__getitem__)) if self.predicate else self.rows.df

    def frame(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The filtered rows as text under their names."""
        return replace(self.rows, df=self._filtered()).named(*(columns or ()))

    def types(self, columns: Sequence[str] | None = None) -> dict[str, str]:
        return infer.dtypes(self.frame(columns))

    def columns(self, columns: Sequence[str] | None = None, cast: bool = True) -> DataFrame:
        """The filtered rows, each column cast to the dtype that all of its fields fit."""
        text = self.frame(columns)
        if not cast:
            return text
        return infer.cast_to(text, infer.dtypes(text))

    def column_batches(self, columns: Sequence[str] | None = None, batch_size: int = 50_000, schema: str = infer.SAMPLE) -> Iterator[pa.Table]:
        """Arrow tables of at most batch_size rows, pulled partition by partition; one empty table where nothing passes.

        schema: `sample` fixes dtypes by the first batch, `global` by all rows, `batch` anew for each batch.
        """
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        if schema not in (infer.SAMPLE, infer.GLOBAL, infer.BATCH):
            raise ValueError(f"no schema mode {schema!r}")
        text = self.frame(columns)
        spark = text.sparkSession
        plan = infer.dtypes(text) if schema == infer.GLOBAL else infer.dtypes(text.limit(batch_size)) if schema == infer.SAMPLE else None
        out = infer.cast_to(text, plan) if plan else text

        def batches() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for r in out.toLocalIterator():
                held.append(tuple(r))
                if len(held) == batch_size:
                    yield held
                    held = []
            if held:
                yield held

        none = True
        for held in batches():
            none = False
            if plan:
                yield spark.createDataFrame(held, out.schema).toArrow()
            else:
                part = spark.createDataFrame(held, text.schema)
                yield infer.cast_to(part, infer.dtypes(part)).toArrow()
        if none:
            yield (out if plan else infer.cast_to(text, infer.dtypes(text))).limit(0).toArrow()

    def tuples(self, columns: Sequence[str] | None = None) -> Iterator[tuple]:
        for r in self.frame(columns).toLocalIterator():
            yield tuple(r)

    def lists(self, columns: Sequence[str] | None = None) -> Iterator[list]:
        return map(list, self.tuples(columns))

    def dicts(self, columns: Sequence[str] | None = None) -> Iterator[dict]:
        names = list(columns or self.rows.names)
        return (dict(zip(names, t, strict=True)) for t in self.tuples(columns))

    def chunks(self, size: int) -> Iterator[list[tuple]]:
        """Lists of at most `size` rows, in order."""
        if size <= 0:
            raise ValueError("chunk size must be positive")
        held: list[tuple] = []
        for t in self.tuples():
            held.append(t)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def excluded(self, predicate: Predicate) -> DataFrame:
        """Rows that pass the reader's predicate but not this one."""
        self.filter(predicate)  # checks the columns
        first = {n: F.col(f"_c{k}") for k, n in reversed(list(enumerate(self.rows.names)))}
        return replace(self.rows, df=self._filtered().filter(~predicate.condition(first.__getitem__))).named()

    def marked(self, predicate: Predicate, name: str = "marked") -> DataFrame:
        """All rows, with a column that says whether the predicate holds."""
        self.filter(predicate)
        first = {n: F.col(f"_c{k}") for k, n in reversed(list(enumerate(self.rows.names)))}
        return self._filtered().select(*[self.rows[c].alias(c) for c in self.rows.names], predicate.condition(first.__getitem__).alias(name))

    def cursor(self) -> "Cursor":
        return Cursor(self.tuples())

    def count(self) -> int:
        return self._filtered().count()


class Cursor:
    """Rows pulled once, in order."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows

    def read_row(self) -> tuple | None:
        return next(self.rows, None)

    def read_chunk(self, most: int) -> list[tuple]:
        """At most `most` rows; none is taken for 0, and the list is empty at the end."""
        out: list[tuple] = []
        while len(out) < most and (r := next(self.rows, None)) is not None:
            out.append(r)
        return out


def reader(spark: SparkSession, source: str | os.PathLike | Iterable[str], dialect: d.Dialect | None = None, **keywords) -> Reader:
    """A reader of a path or of an iterable of text, which is written to the shared folder once. keywords: as Python's csv module."""
    made = dialect or d.python_dialect(**keywords)
    if isinstance(source, (str, os.PathLike)):
        return Reader(scan(spark, os.fspath(source), made))
    text = "".join(x if x.endswith(("\n", "\r")) else x + "\n" for x in source)
    path = scratch(spark, "spooled")
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.text(path)
    return Reader(scan(spark, path, made, exact=True))
