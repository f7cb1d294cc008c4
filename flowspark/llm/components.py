"""Connected components by contraction.

Each round every node points to its smallest neighbour or itself, pointers are
followed a few steps, and edges move to what their ends point to. A node that
is no local minimum disappears in each round, so edges shrink geometrically.
Rounds are written tables; only the number of edges left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import Scratch

_JUMPS = 2


def _points(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    it can reach. Loops, repeated edges and both directions are fine; an empty
    table gives an empty result. Edges must not hold nulls."""
    spark = edges.sparkSession
    scratch = Scratch(spark, tag)
    left, count = scratch.write(edges.where("a <> b").select("a", "b").distinct(), "edges", {"n": F.count(F.lit(1))})
    n, known = count["n"], None
    while n:
        points = scratch.write(_points(left), "points")
        jumped = points
        for _ in range(_JUMPS):
            ahead = jumped.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = jumped.join(ahead, "to").select("node", F.col("further").alias("to"))
        jumped = scratch.write(jumped, "jumped")
        ends = jumped.select(F.col("node").alias("a"), F.col("to").alias("x"))
        starts = jumped.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(ends, "a").join(starts, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after, count = scratch.write(moved, "edges", {"n": F.count(F.lit(1))})
        if known is None:
            new = jumped
        else:
            via = jumped.select(F.col("node").alias("component"), F.col("to").alias("__to"))
            new = scratch.write(known.join(via, "component", "left").select("node", F.coalesce("__to", "component").alias("component")), "known")
        scratch.drop(points, left, *([jumped, known] if known is not None else []))
        known = new if known is not None else jumped.withColumnRenamed("to", "component")
        left, n = after, count["n"]
    scratch.drop(left)
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
