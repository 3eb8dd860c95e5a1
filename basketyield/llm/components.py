"""Connected components by alternating star contraction, as joins and aggregations.

Every round hangs the neighbours of a node below the smallest of them, first
the larger ones, then the smaller ones.  The number of rounds grows with the
logarithm of the largest component.  Rounds are written tables; the driver
sees two numbers of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stage
from .common import never_broadcast


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(a, b)`` that is not that smallest one.

    A star's centre can have any number of leaves: the minimum of a node's
    neighbours is an aggregate, and no list of neighbours is held.
    """
    current = stage.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges_0"
    )
    step = 0
    while True:
        step += 1
        # large star: neighbours above a node go to the smallest of its neighbourhood
        around = _both_ways(current)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(never_broadcast(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage.write(large.where("a <> b").distinct(), f"large_{step}")
        # small star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(never_broadcast(least), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after, seen = stage.write_observed(
            small.where("a <> b").distinct(),
            f"edges_{step}",
            rows="count(1)",
            mix="coalesce(sum(cast(xxhash64(a, b) as decimal(38, 0))), 0)",
        )
        if step > 1 and (seen["rows"], seen["mix"]) == last:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = (seen["rows"], seen["mix"])
        stage.drop(f"large_{step}")
        stage.drop(f"edges_{step - 1}")
        current = after
