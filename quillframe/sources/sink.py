"""Delimited text out: minimal quoting, or all strings quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.scalars import number_text

NUMBERS = ("tinyint", "smallint", "int", "bigint")


def text_of(name: str, kind: str, places: int | None = None) -> Column:
    """A column as the writer spells it: null is empty; with `places`, fractions as number_text has them, else as Spark casts them."""
    c = F.col(f"`{name}`")
    if places is not None and (kind in ("double", "float") or kind.startswith("decimal")):
        return number_text(c, places)
    return F.coalesce(c.cast("string"), F.lit(""))


def as_text(df: DataFrame, places: int | None = None) -> DataFrame:
    """All columns as strings, nulls empty."""
    return df.select(*[text_of(n, t, places).alias(n) for n, t in df.dtypes])


def quoted(field: Column, delimiter: str = ",", quote: str = '"', always: bool = False) -> Column:
    """A field with the quotes that it needs: around a quote, delimiter or line end, inner quotes doubled."""
    whole = F.concat(F.lit(quote), F.replace(field, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    if always:
        return whole
    needs = field.contains(quote) | field.contains(delimiter) | field.contains("\r") | field.contains("\n")
    return F.when(needs, whole).otherwise(field)


def lines(df: DataFrame, delimiter: str = ",", quote: str = '"', minimal: bool = True, places: int | None = 5) -> DataFrame:
    """One column `value`: each row as a record. minimal=False quotes all strings; numbers stay bare."""
    fields = [quoted(text_of(n, t, places), delimiter, quote, always=not minimal and t == "string") for n, t in df.dtypes]
    return df.select(F.concat_ws(delimiter, *fields).alias("value"))


def record_lines(records: DataFrame, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """Records of any width (fields: array) as lines, minimally quoted."""
    return records.select(F.array_join(F.transform("fields", lambda x: quoted(x, delimiter, quote)), delimiter).alias("value"))


def write(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, minimal: bool = True, single_file: bool = False, places: int | None = None, mode: str = "errorifexists") -> None:
    """Writes df as delimited files in a folder. single_file gathers all rows in one task; only for what fits one."""
    out = df.coalesce(1) if single_file else df
    if minimal:
        options = {"sep": delimiter, "quote": quote, "escape": quote, "header": str(header).lower(), "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}
        as_text(out, places).write.mode(mode).options(**options).csv(path)
        return
    body = lines(out, delimiter, quote, minimal=False, places=places)
    if header:
        names = delimiter.join(quote + n.replace(quote, quote * 2) + quote for n in df.columns)
        first = df.sparkSession.range(1, numPartitions=1).select(F.lit(names).alias("value"))
        if not single_file:
            raise ValueError("a header with all strings quoted wants single_file")
        body = first.unionByName(body).coalesce(1)
    body.write.mode(mode).text(path)


def write_tsv(df: DataFrame, path: str, **options) -> None:
    write(df, path, delimiter="\t", **options)


def write_rows(spark, path: str, rows, fieldnames=None, write_header: bool = True, minimal: bool = True, delimiter: str = ",") -> None:
    """Writes Python rows (sequences or dicts; None and missing keys are empty, other values as str has them) as one file.

    Names come from fieldnames or the first dict. No rows but fieldnames: the header alone.
    """
    rows = list(rows)
    if fieldnames is None and rows and isinstance(rows[0], dict):
        fieldnames = list(rows[0])
    text = lambda v: "" if v is None else str(v)
    data = [[text(r.get(n)) for n in fieldnames] if isinstance(r, dict) else [text(v) for v in r] for r in rows]
    made = [list(map(str, fieldnames))] if fieldnames is not None and write_header else []
    df = spark.createDataFrame([(k, r) for k, r in enumerate(made + data)], "ord long, fields array<string>")
    fields = F.transform("fields", lambda x: quoted(x, delimiter, always=not minimal))
    df.coalesce(1).sortWithinPartitions("ord").select(F.array_join(fields, delimiter).alias("value")).write.text(path)
