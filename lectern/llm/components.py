"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import discard, durable, join_facts


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Links every neighbour that is larger (or not larger) than a node to the least node around it."""
    if large:
        around = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    met = join_facts(around, least, ["u"], total)  # the hub of a star may have most of the edges
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return durable(moved.where("u <> v").distinct(), "edges", after=(edges,))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none but from larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up = 1 and down = 1)").isEmpty() and edges.where("v > u").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v) but the least of each component.

    ``component`` is that least node. Each step is written to the shared folder, so the lineage stays
    short; the number of rounds grows with the logarithm of the longest path. No node's neighbours are
    ever gathered: a step is a grouped minimum and a join, in which the nodes with most edges are broadcast.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        total = now.count()
        if not total or _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = _star(_star(now, True, total), False, total)
    discard(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
