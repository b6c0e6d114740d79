"""Connected components by alternating star contraction on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.runtime import Scratch


def _pull(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Hang each node's neighbours on the least node of its neighbourhood.

    ``edges`` holds (a, b) with a > b. The large star looks at all neighbours and moves the larger
    ones; the small star looks at the smaller ones and moves them and the node itself.
    """
    seen = edges if smaller_only else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if smaller_only:
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.withColumnRenamed("m", "b")).where("a > b").distinct()
    return seen.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(least.where("a > m").withColumnRenamed("m", "b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Direction and repeated edges don't matter, a null end drops the edge, a self-edge keeps its node.
    Hubs are safe: minima are combined before the shuffle and the joins are splittable by AQE.
    """
    given = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null")
    nodes = given.select(F.col("x").alias("node")).union(given.select("y")).distinct()
    now = scratch.stage(given.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a > b").distinct())
    mark = None
    for _ in range(max_rounds):
        grown = scratch.stage(_pull(_pull(now, False), True))
        seen = grown.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = grown
        if (seen[0], seen[1]) == mark:
            break
        mark = (seen[0], seen[1])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now, nodes["node"] == now["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
