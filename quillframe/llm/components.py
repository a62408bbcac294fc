"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillframe.llm.common import stored

#: Rows of a task: small graphs take few tasks a round, large ones as many as the session's shuffles have.
TASK_ROWS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for each node of `edges` (a, b: long; direction doesn't matter).

    Each round gives a node the least label among its neighbours, then that label's own label, so that paths halve; tables of each
    round are written to the shared folder. Null ends are left out, repeated edges count once; no edges give an empty table. Other
    columns aren't read. A node with many neighbours is combined before the shuffle and, in joins, left to the skew handling of Spark.
    """
    edges = edges.select("a", "b").filter("a <> b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    tasks = both.count() // TASK_ROWS + 1
    sums = lambda df, seen: df.observe(seen, F.sum(F.col("component").cast("decimal(38,0)")).alias("total"))
    seen = Observation()
    labels = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("component"))
    labels = stored(sums(labels.coalesce(tasks), seen), "cc")
    total = seen.get["total"]
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").coalesce(tasks).groupBy("a").agg(F.min("component").alias("_m"))
        low = stored(labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "_m").alias("component")).coalesce(tasks), "cc")
        up = low.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        seen = Observation()
        now = low.join(up, low["component"] == up["_n"]).select("node", F.col("_c").alias("component")).coalesce(tasks)
        labels = stored(sums(now, seen), "cc")
        if seen.get["total"] in (None, total):  # labels only fall
            return labels
        total = seen.get["total"]
