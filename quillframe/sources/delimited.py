"""Delimited files as DataFrames.

Two paths give the same rows. The fast path is Spark's own reader with options that match the dialect; it splits files and prunes
columns. The exact path tokenises a file in one task and serves what the fast path can't: records of any width, blank records, raw
text and offsets, headers below the first record, mixed record ends, and ends inside quotes that must stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources import dialect as d
from quillframe.sources.paths import files, head

RECORDS = "file string, ord long, offset long, raw string, fields array<string>"
TOO_SHORT, TOO_LONG = "Line too short ", "Line too long "
HEAD = 500_000


@dataclass(frozen=True)
class Rows:
    """Records as columns _c0, _c1, ... and their names, which may repeat or be empty. df may have further columns (_file, _ord)."""

    df: DataFrame
    names: tuple[str, ...]
    policy: str = d.EXACT

    def position(self, name: str) -> int:
        k = d.position(self.names, name, self.policy)
        if k < 0:
            raise KeyError(f"Column not found: {name}")
        return k

    def __getitem__(self, key: str | int) -> Column:
        if isinstance(key, int):
            if not -len(self.names) <= key < len(self.names):
                raise IndexError("Index out of bounds.")
            key %= len(self.names)
            return F.col(f"_c{key}")
        return F.col(f"_c{self.position(key)}")

    def named(self, *columns: str) -> DataFrame:
        """The columns under their own names, all or the given ones in that order."""
        wanted = columns or self.names
        return self.df.select(*[self[c].alias(c) for c in wanted])


def sniff(spark: SparkSession, path: str, dialect: d.Dialect) -> tuple[list[str], d.Resolved, bytes]:
    """The files, the dialect settled by the first one's first bytes, and these bytes."""
    found = files(spark, path)
    data = head(spark, found[0], HEAD)
    return found, d.resolve(dialect, data), data


def scan(spark: SparkSession, path: str, dialect: d.Dialect | None = None, multiline: bool = True, exact: bool | None = None) -> Rows:
    """Rows of the files at `path`. All files have the first one's dialect and names, and a header each if it has one.

    multiline=False lets large files split, where no field holds a line end; carriage returns end records there as well. exact: forces
    a path; otherwise the fast one is taken where it gives the same rows. With multiline, Spark's reader settles the record end by what
    comes first in a file, so all files are searched for a carriage return, by a splittable scan, before that path is taken.
    """
    found, r, data = sniff(spark, path, dialect or d.guessed())
    fast = r.header <= 0 and r.dialect.ragged == d.IGNORE_ROW and r.width > 0
    if fast and exact is None and multiline:
        fast = b"\r" not in data and not returns(spark, found)
    if exact or (exact is None and not fast):
        return shaped(exact_records(spark, found, r), r)
    return fast_scan(spark, found, r, multiline)


def returns(spark: SparkSession, paths: list[str]) -> bool:
    """Whether any of the files holds a carriage return. Reads all of them where there is none."""
    return not spark.read.option("lineSep", "\n").text(paths).filter(F.col("value").contains("\r")).isEmpty()


def names_of(r: d.Resolved) -> tuple[str, ...]:
    return r.names if r.names is not None else tuple(f"_c{k}" for k in range(r.width))


def fast_options(r: d.Resolved) -> dict[str, str]:
    return {
        "sep": r.delimiter, "quote": r.dialect.quote or "", "escape": r.dialect.quote or "", "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE", "mode": "DROPMALFORMED", "maxColumns": str(max(20_480, r.width + 1)), "maxCharsPerColumn": "-1",
        "header": str(r.header == 0).lower(), "enforceSchema": "true", "nullValue": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8",
    }


def string_schema(width: int) -> str:
    return ", ".join(f"_c{k} string" for k in range(width))


def trim_fields(df: DataFrame, width: int, chars) -> DataFrame:
    field = lambda k: F.coalesce(F.col(f"_c{k}"), F.lit(""))
    cut = (lambda c: F.btrim(c, F.lit("".join(chars)))) if chars else (lambda c: c)
    return df.select(*[cut(field(k)).alias(f"_c{k}") for k in range(width)], *[c for c in df.columns if not c.startswith("_c")])


def fast_scan(spark: SparkSession, paths: list[str], r: d.Resolved, multiline: bool = True) -> Rows:
    df = spark.read.options(**fast_options(r), multiLine=str(multiline).lower()).schema(string_schema(r.width)).csv(paths)
    return Rows(trim_fields(df, r.width, r.dialect.trim), names_of(r), r.dialect.name_policy)


def _tokenise(r: d.Resolved):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                content = bytes(content)
                mark = 3 if content.startswith(b"\xef\xbb\xbf") else 0
                rows = []
                for k, (at, fields, raw) in enumerate(d.records(content[mark:], r.delimiter, r.dialect.quote)):
                    if r.dialect.trim:
                        fields = [d.trimmed(x, r.dialect.trim) for x in fields]
                    rows.append((file, k, at + mark, raw.decode("utf-8", "replace"), fields))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["file", "ord", "offset", "raw", "fields"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "ord", "offset", "raw", "fields"])

    return run


def exact_records(spark: SparkSession, paths: list[str], r: d.Resolved) -> DataFrame:
    """file, ord (from 0 in the file), offset (bytes), raw, fields of each record behind the header, ragged policy applied."""
    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return policed(content.mapInPandas(_tokenise(r), RECORDS), r)


def parse_texts(texts: DataFrame, r: d.Resolved, text: str = "text") -> DataFrame:
    """Records of in-memory texts, one file each: as exact_records, with file null."""
    content = texts.select(F.lit(None).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    return policed(content.mapInPandas(_tokenise(r), RECORDS), r)


def parse(spark: SparkSession, text: str, dialect: d.Dialect | None = None) -> Rows:
    """Rows of one text in memory."""
    r = d.resolve(dialect or d.guessed(), text.encode()[:HEAD])
    return shaped(parse_texts(spark.createDataFrame([(text,)], "text string"), r), r)


def policed(rows: DataFrame, r: d.Resolved) -> DataFrame:
    rows = rows.filter(F.col("ord") > r.header)
    n, width = F.size("fields"), r.width
    if r.dialect.ragged == d.IGNORE_ROW:
        return rows.filter(n == width)
    if r.dialect.ragged == d.KEEP_NON_EMPTY:
        return rows.filter(n > 0)
    if r.dialect.ragged == d.THROW:
        bad = F.when(n < width, F.raise_error(F.concat(F.lit(TOO_SHORT), F.col("raw")))).when(n > width, F.raise_error(F.concat(F.lit(TOO_LONG), F.col("raw"))))
        return rows.withColumn("fields", F.coalesce(bad.cast("array<string>"), F.col("fields")))
    return rows


def shaped(rows: DataFrame, r: d.Resolved) -> Rows:
    """Records as columns; fields that a record lacks are empty, those beyond the names stay in fields only."""
    return Rows(rows.select(*[F.coalesce(F.get("fields", F.lit(k)), F.lit("")).alias(f"_c{k}") for k in range(r.width)], "file", "ord", "offset", "raw", "fields"), names_of(r), r.dialect.name_policy)


def file_info(spark: SparkSession, path: str, dialect: d.Dialect | None = None) -> DataFrame:
    """One row: file, delimiter, n_rows, n_cols."""
    rows = scan(spark, path, dialect)
    r = sniff(spark, path, dialect or d.guessed())[1]
    return rows.df.agg(F.count("*").alias("n_rows")).select(F.lit(path).alias("file"), F.lit(r.delimiter).alias("delimiter"), "n_rows", F.lit(len(rows.names)).cast("long").alias("n_cols"))


def column_names(spark: SparkSession, path: str, dialect: d.Dialect | None = None) -> tuple[str, ...]:
    return names_of(sniff(spark, path, dialect or d.guessed())[1])


def column_position(spark: SparkSession, path: str, name: str, dialect: d.Dialect | None = None) -> int:
    """-1 where there is no such column."""
    return d.position(column_names(spark, path, dialect), name)
