"""Connected components by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every node of links (a long, b long).

    Self links, repeated links and nulls add nothing; no links give no rows. Each round is written to the shared folder, the
    driver sees two sums of it. With rounds, so many are made and no more: nodes of one group are linked then, but a
    component may still come as several groups.
    """
    edges = written(links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    state, made = None if rounds else _state(edges), 0
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "low b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        last, edges = edges, written(small.where("a > b").distinct(), "edges")
        forget(last)
        made += 1
        if rounds:
            if made == rounds:
                break
            continue
        before, state = state, _state(edges)
        if state == before:
            break
    found = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = edges.select("b").distinct().join(found, edges["b"] == found["a"], "left_anti")
    return found.selectExpr("a node", "b component").union(roots.selectExpr("b node", "b component"))
