"""What several operators share: tables, the shared folder, words, salted joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # a folder of this machine is of no use to others
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="quillframe-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a URI."""
    root = shared_root(spark)
    return f"{root if ':' in root.split('/')[0] else 'file://' + root}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files when it has ended, not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    return stored_parts([df], name)


def stored_parts(parts: list[DataFrame], name: str, freed: bool = False) -> DataFrame:
    """Writes frames of one schema to one table, one after the other. freed: shuffle files of one are gone before the next."""
    spark = parts[0].sparkSession
    path, before = shared_path(spark, name), spark.conf.get(FILE_CLEANUP)
    try:
        if freed:
            spark.conf.set(FILE_CLEANUP, "true")
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(parts[0].schema).parquet(path)


def replaced(text: Column, chars: str, by: str = "") -> Column:
    """text with each of the characters replaced; byte searches, much cheaper than a regular expression or translate."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array. Splitting at one plain character spares compiling a pattern for each row."""
    return F.array_remove(F.split(replaced(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " "), " ", -1), "")


def salted_left(rows: DataFrame, few: DataFrame, key: str, by: Column, salts: int = 16) -> DataFrame:
    """rows left-joined with `few` (at most one row a key), each key dealt over `salts` partitions by the hash `by`: a hot key doesn't meet in one task."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int")).join(few, [key, "_salt"], "left").drop("_salt")


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 16) -> None:
    """Lowers the session's limits on what goes to a Python worker at once, so that batches of long texts fit in memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = spark.conf.get(key).removesuffix("b").strip()
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))
