"""Tables with row positions: keys, lookups, grouping and edits. Every edit gives a new table.

A position is a column `_pos`, from 0 without gaps in source order. It is assigned only on request: rows are range-partitioned by the
order, and the counts of the partitions, few whatever the rows, give each its start.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.scalars import convert
from quillframe.sources.paths import scratch

OVERWRITE, KEEP_FIRST, THROW = "overwrite", "keep_first", "throw"
DUPLICATE = "Duplicate key encountered."
#: Edits and key lists up to this many go into expressions; more are joined.
INLINE = 500


def positioned(df: DataFrame, *order: Column | str, start: int = 0) -> DataFrame:
    """df with `_pos`, from `start` in the given order."""
    spark = df.sparkSession
    path = scratch(spark, "positions")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.parquet(path)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", (before - F.col("_first") + start).alias("_shift"))  # a row a partition: small
    return rows.join(F.broadcast(parts), "_part").withColumn("_pos", F.col("_mono") + F.col("_shift")).drop("_part", "_mono", "_shift")


@dataclass(frozen=True)
class Table:
    """df: the columns, `_pos`, and `_key` if keyed. columns: names in order. key: the key column's name, "" for a function."""

    df: DataFrame
    columns: tuple[str, ...]
    key: str | None = None

    @classmethod
    def of(cls, df: DataFrame, *order: Column | str) -> "Table":
        """A table in the given order, or with df's own `_pos`."""
        columns = tuple(c for c in df.columns if c != "_pos")
        return cls(df if "_pos" in df.columns else positioned(df, *order), columns)

    # --- reading

    def rows(self) -> DataFrame:
        return self.df.select("_pos", *self.columns)

    def size(self) -> int:
        return self.df.count()

    def at(self, i: int) -> DataFrame:
        if i < 0:
            raise IndexError("Index out of bounds.")
        return self.df.filter(F.col("_pos") == i).select(*self.columns)

    def column(self, name: str, kind: str = "string") -> DataFrame:
        """_pos, value, error of a column read as `kind`."""
        self._known(name)
        c = convert(F.col(name), kind)
        return self.df.select("_pos", c["value"].alias("value"), c["error"].alias("error"))

    def _known(self, name: str) -> None:
        if name not in self.columns:
            raise KeyError(f"Column not found: {name}")

    # --- keys

    def keyed(self, key: str | Column, kind: str = "string", policy: str = OVERWRITE, throw_on_missing: bool = True) -> "Table":
        """A key a row. Of rows with one key, OVERWRITE takes the last one's values at the first one's place, KEEP_FIRST the first, THROW fails.

        Values are reduced key by key with a map-side combine. A field that doesn't convert fails, or counts as the kind's zero when
        throw_on_missing is off; positions stay those of the source, so gaps are left where rows fell away.
        """
        if isinstance(key, str):
            self._known(key)
            c = convert(F.col(key), kind)
            zero = F.lit("") if kind == "string" else F.lit(False) if kind == "bool" else F.lit(0)
            value = F.when(c["error"].isNull(), c["value"]).otherwise(F.raise_error(F.concat(F.lit("Error retrieving column value for row key: "), c["error"])) if throw_on_missing else zero.cast({"string": "string", "bool": "boolean"}.get(kind, "long")))
        else:
            value = key
        rows = self.df.select("_pos", value.alias("_key"), F.struct(*self.columns).alias("_row"))
        if policy == THROW:
            n = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_pos").alias("_pos"), F.min_by("_row", "_pos").alias("_row"))
            out = n.withColumn("_key", F.when(F.col("_n") > 1, F.raise_error(F.lit(DUPLICATE))).otherwise(F.col("_key")))
        else:
            pick = F.min_by if policy == KEEP_FIRST else F.max_by
            out = rows.groupBy("_key").agg(pick("_row", "_pos").alias("_row"), F.min("_pos").alias("_pos"))
        return Table(out.select("_pos", "_key", "_row.*"), self.columns, key if isinstance(key, str) else "")

    def _keyed(self) -> None:
        if self.key is None:
            raise RuntimeError("This DataFrame was created without a key column.")

    def lookup(self, *keys) -> DataFrame:
        """Rows of the keys; a key without a row gives none."""
        self._keyed()
        return self.df.filter(F.col("_key").isin(*keys)).select("_key", *self.columns)

    def lookup_all(self, keys: DataFrame, name: str) -> DataFrame:
        """Rows whose key is in a column of `keys`, of any size."""
        self._keyed()
        return self.df.join(keys.select(F.col(name).alias("_key")).distinct(), "_key", "left_semi").select("_key", *self.columns)

    def contains(self, key) -> bool:
        return bool(self.lookup(key).limit(1).count())

    # --- grouping

    def group_by(self, by: str | Column) -> DataFrame:
        """group, positions (sorted) of each value of a column or expression."""
        if isinstance(by, str):
            self._known(by)
            by = F.col(by)
        return self.df.groupBy(by.alias("group")).agg(F.sort_array(F.collect_list("_pos")).alias("positions"))

    def group_stats(self, by: str | Column, *aggregates: Column) -> DataFrame:
        """Aggregates a group, without the positions: what a group of any size can do."""
        return self.df.groupBy((F.col(by) if isinstance(by, str) else by).alias("group")).agg(*aggregates)

    # --- edits

    def edit(self, cells: Mapping[tuple[int, str], str]) -> "Table":
        """Cells by position and column; of edits of one cell the last stands."""
        for _, name in cells:
            self._known(name)
        if len(cells) > INLINE:
            rows = self.df.sparkSession.createDataFrame([(i, n, v) for (i, n), v in cells.items()], "_pos long, _name string, _value string")
            return self.overlay(rows)
        out = {}
        for name in {n for _, n in cells}:
            c = F.col(name)
            for (i, n), v in cells.items():
                if n == name:
                    c = F.when(F.col("_pos") == i, F.lit(v)).otherwise(c)
            out[name] = c
        return replace(self, df=self.df.withColumns(out))

    def overlay(self, edits: DataFrame) -> "Table":
        """Edits as rows (_pos, _name, _value), one a cell."""
        wide = edits.groupBy("_pos").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("_edits"))
        joined = self.df.join(wide, "_pos", "left")
        return replace(self, df=joined.select(*[c for c in self.df.columns if c not in self.columns], *[F.when(F.map_contains_key("_edits", c), F.element_at("_edits", c)).otherwise(F.col(c)).alias(c) for c in self.columns]))

    def insert_row(self, i: int, values: Sequence[str], size: int | None = None) -> "Table":
        if len(values) != len(self.columns):
            raise ValueError("Inserted row width does not match the column count.")
        if self.key == "":
            raise RuntimeError("Rows can't be inserted in a table keyed by a function.")
        if i < 0 or size is not None and i > size:
            raise IndexError("Index out of bounds.")
        if self.key:
            raise RuntimeError("Insert before keying: a keyed table would have to be checked for the key.")
        moved = self.df.withColumn("_pos", F.when(F.col("_pos") >= i, F.col("_pos") + 1).otherwise(F.col("_pos")))
        new = self.df.sparkSession.createDataFrame([(i, *values)], ", ".join(["_pos long", *[f"`{c}` string" for c in self.columns]]))
        return replace(self, df=moved.unionByName(new))

    def insert_column(self, i: int, name: str, value: str | Column = "") -> "Table":
        if not name:
            raise ValueError("Column name can't be empty.")
        if name in self.columns:
            raise ValueError(f"Column already exists: {name}")
        if not 0 <= i <= len(self.columns):
            raise IndexError("Index out of bounds.")
        columns = (*self.columns[:i], name, *self.columns[i:])
        return replace(self, df=self.df.withColumn(name, F.lit(value) if isinstance(value, str) else value), columns=columns)

    def append_column(self, name: str, value: str | Column = "") -> "Table":
        return self.insert_column(len(self.columns), name, value)

    def erase_column(self, name: str) -> "Table":
        self._known(name)
        if name == self.key:
            raise ValueError("The key column can't be erased.")
        return replace(self, df=self.df.drop(name), columns=tuple(c for c in self.columns if c != name))

    def erase_row(self, i: int) -> "Table":
        rest = self.df.filter(F.col("_pos") != i)
        return replace(self, df=rest.withColumn("_pos", F.when(F.col("_pos") > i, F.col("_pos") - 1).otherwise(F.col("_pos"))))

    def selected_rows(self, mask: Column) -> "Table":
        """Rows where mask holds, edits included, without a key; positions anew."""
        rest = self.df.filter(F.coalesce(mask, F.lit(False))).select(F.col("_pos").alias("_was"), *self.columns)
        return Table(positioned(rest, "_was").drop("_was"), self.columns)

    def map_columns(self, names: Sequence[str], f: Callable[[Column], Column]) -> "Table":
        for n in names:
            self._known(n)
        return replace(self, df=self.df.withColumns({n: f(F.col(n)) for n in names}))
