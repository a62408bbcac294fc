"""Files that driver and executors share, and the first bytes of one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir, or in a folder of our own where that is unset (single machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # a folder of this machine is of no use to others
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quillframe-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    out = []
    for s in found or []:
        if s.isDirectory():
            inside = [x.getPath() for x in fs.listStatus(s.getPath()) if x.isFile()]
            out += [str(p) for p in inside if not p.getName().startswith(("_", "."))]
        else:
            out.append(str(s.getPath()))
    if not out:
        raise FileNotFoundError(f"Cannot open file {path}")
    return sorted(out)


def head(spark: SparkSession, file: str, size: int = 500_000) -> bytes:
    """The first `size` bytes of a file in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()
