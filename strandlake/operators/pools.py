"""Greedy pools over a table of conflicts: what taking rows in order of rank, each unless it conflicts with one taken, would take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import settled


def greedy(nodes: DataFrame, conflicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of nodes (keys, id, rank) of each group those that are taken in order of (rank, id), unless they conflict with one taken
    before. conflicts (keys, a, b) may come either way round, repeatedly or with ids that no node has; a node that conflicts
    with itself is never taken.

    A round takes every node without an undecided one before it among its conflicts, and drops those that conflict with what
    was taken: many nodes a round, in all groups at once, and in random orders about as many rounds as the nodes' number has
    digits. A chain of conflicts in the order of ranks takes a round for every two of its nodes. Null keys are no group.
    """
    own = conflicts.where("a = b").select(*keys, F.col("a").alias("id")).distinct()
    place = F.struct("rank", "id").alias("place")
    left = settled(nodes.select(*keys, "id", place).join(own, [*keys, "id"], "left_anti"))
    both = conflicts.where("a <> b").select(*keys, F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()
    ends = both.join(left.select(*keys, F.col("id").alias("a"), F.col("place").alias("pa")), [*keys, "a"]).join(left.select(*keys, F.col("id").alias("b"), F.col("place").alias("pb")), [*keys, "b"])
    edges = settled(ends.where("pa < pb").select(*keys, "a", "b"))
    taken = None
    while not left.isEmpty():
        waiting = edges.select(*keys, F.col("b").alias("id")).distinct()
        now = settled(left.join(waiting, [*keys, "id"], "left_anti"))
        taken = now if taken is None else taken.union(now)
        gone = settled(edges.join(now.select(*keys, F.col("id").alias("a")), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("id")).distinct().union(now.select(*keys, "id")))
        left = settled(left.join(gone, [*keys, "id"], "left_anti"))
        for end in ("a", "b"):
            edges = edges.join(gone.withColumnRenamed("id", end), [*keys, end], "left_anti")
        edges = settled(edges)
    return (left if taken is None else taken).select(*keys, "id", "place.rank")


def pooled(nodes: DataFrame, conflicts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """nodes with in_pool: whether a pool of size places, filled in order of rank, takes the node. A full pool takes no more."""
    order = Window.partitionBy(*keys).orderBy("rank", "id")
    first = greedy(nodes, conflicts, keys).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= size).select(*keys, "id", F.lit(True).alias("_in"))
    return nodes.join(first, [*keys, "id"], "left").withColumn("in_pool", F.coalesce("_in", F.lit(False))).select(*nodes.columns, "in_pool")
