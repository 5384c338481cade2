"""Connected components as repeated contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.common import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is one node of the component.

    Each round maps a node to the neighbour with the smallest hash (or itself) and contracts, which
    removes a constant share of the nodes on average, for any shape of graph.  Counts of hot nodes are combined
    before the shuffle, and the joins have plain exchanges on both sides, which adaptive
    execution splits.  Nothing but a count comes to the driver.  Self-loops and repeated edges
    are allowed; no edges give no rows.
    """
    edges = checkpointed(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        if len(maps) == most_rounds:
            raise RuntimeError("the contraction doesn't end")
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        low = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("other"), "other")).alias("low"))
        up = checkpointed(low.select("node", F.least("low", F.struct(F.xxhash64("node"), F.col("node").alias("other")))["other"].alias("up")))
        maps.append(up)
        left = edges.join(up.withColumnRenamed("up", "ua"), F.col("a") == F.col("node")).select("ua", "b")
        both = left.join(up.withColumnRenamed("up", "ub"), F.col("b") == F.col("node")).select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        both = both.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = checkpointed(both.distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = maps[0].withColumnRenamed("up", "label")
    for up in maps[1:]:
        step = up.select(F.col("node").alias("from"), "up")
        label = label.join(step, F.col("label") == F.col("from"), "left").select("node", F.coalesce("up", "label").alias("label"))
    return checkpointed(label)
