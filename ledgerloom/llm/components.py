"""Connected components of an edge table, without a group ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_scratch


def _mins(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours (edges point both ways)."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def roots(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the component's least node.

    Alternates large-star and small-star: each joins every edge with the least
    neighbour of one end and hangs the other end below it.  All steps are equi
    joins and min aggregates (combined before they are shuffled), so a hub's
    rows can be split over tasks; the edge table never grows.  Each round is
    written to the shared folder.  Nulls and loops are no edges.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_mins(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        after = cut(small, "edges")
        drop_scratch(now)
        now, was = after, state
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == was or not state[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
