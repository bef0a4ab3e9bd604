"""Connected components by alternating large-star and small-star rounds.

Each round points every node at the least node known in its neighbourhood:
the large star moves the larger neighbours of a node to its least neighbour,
the small star moves the smaller ones. Edges never grow in number, and the
rounds end when the edges are stars around each component's least node.
Every round is two aggregations (summed before the shuffle) and two joins on
the same keys, written to the checkpoint folder so that plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.plans.lineage import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())


def star_forest(edges: DataFrame, u: str = "u", v: str = "v", pairs: bool = False) -> DataFrame:
    """``x, y``: every node x that isn't the least of its component, with that least node y.

    Self-loops, nulls and repeated edges have no effect; nodes are of any
    type that has an order. ``pairs``: edges are known to be distinct pairs
    with u below v, so they need no shuffle for that.
    """
    x, y = F.greatest(F.col(u), F.col(v)), F.least(F.col(u), F.col(v))
    now = edges.where(F.col(u) != F.col(v)).select(x.alias("x"), y.alias("y"))
    now = now if pairs else materialize(now.distinct())
    was, sign = None, _signature(now)
    while sign != was and sign[0]:
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        root = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.where(F.col("x") != F.col("y")).join(root, "x")
        moved = small.where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = materialize(moved.unionByName(root.select("x", F.col("m").alias("y"))).where(F.col("x") != F.col("y")).distinct())
        was, sign = sign, _signature(now)
    return now


def connected_components(vertices: DataFrame, edges: DataFrame, vertex: str = "id", u: str = "u", v: str = "v", pairs: bool = False) -> DataFrame:
    """``vertices`` with ``component``, the least vertex reachable; a vertex without edges is its own."""
    forest = star_forest(edges, u, v, pairs)
    return vertices.join(forest.withColumnRenamed("x", vertex), vertex, "left").withColumn("component", F.coalesce("y", F.col(vertex))).drop("y")
