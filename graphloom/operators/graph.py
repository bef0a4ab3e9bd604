"""Operators on a graph of ``vertices`` (id, ...) and ``edges`` (id, subject_id, object_id, ...).

Edges are stored once, with a direction; where a traversal ignores it, both
orientations are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.components import connected_components
from graphloom.plans.lineage import materialize


def pair(s: str = "subject_id", o: str = "object_id") -> list[Column]:
    """The canonical unordered pair of an edge."""
    return [F.least(s, o).alias("u"), F.greatest(s, o).alias("v")]


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end (``node, other``); a loop once."""
    one = edges.withColumn("node", F.col("subject_id")).withColumn("other", F.col("object_id"))
    two = edges.where("subject_id <> object_id").withColumn("node", F.col("object_id")).withColumn("other", F.col("subject_id"))
    return one.unionByName(two)


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: ends of edges at each node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def edge_degrees(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Edges with ``edge_degree``: the sum of their ends' degrees (0 if ``strict``)."""
    if strict:
        return edges.withColumn("edge_degree", F.lit(0).cast("long"))
    own = degrees(edges)
    out = edges.join(own.select(F.col("id").alias("subject_id"), F.col("degree").alias("d1")), "subject_id")
    out = out.join(own.select(F.col("id").alias("object_id"), F.col("degree").alias("d2")), "object_id")
    return out.withColumn("edge_degree", F.col("d1") + F.col("d2")).drop("d1", "d2")


def has_nodes(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """``id, found`` for each given id."""
    known = vertices.select("id", F.lit(True).alias("found")).distinct()
    return ids.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def has_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``u, v, found`` for each given pair, in either direction."""
    known = edges.select(*pair()).distinct().withColumn("found", F.lit(True))
    asked = pairs.select("u", "v", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    known = known.select(F.col("u").alias("a"), F.col("v").alias("b"), "found")
    return asked.join(known, ["a", "b"], "left").select("u", "v", F.coalesce("found", F.lit(False)).alias("found"))


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair: the one of the smallest id."""
    return edges.withColumns({"u": F.least("subject_id", "object_id"), "v": F.greatest("subject_id", "object_id")}).groupBy("u", "v").agg(F.min("id").alias("id"))


def incident_edges(probes: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges at each probe (``node``), turned so that the subject is the probe, with the names of both ends (an id where there is none)."""
    rows = both_ways(edges).join(probes.select("node"), "node")
    for side, col in (("subject", "node"), ("object", "other")):
        names = vertices.select(F.col("id").alias(col), F.col("entity_name").alias(f"{side}_label"))
        rows = rows.join(names, col, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", F.col(col)))
    return rows


def neighbours(probes: DataFrame, edges: DataFrame, vertices: DataFrame, relation_types: list[str] | None = None) -> DataFrame:
    """``node`` and the neighbour's record, once for every edge between them."""
    rows = both_ways(edges)
    if relation_types is not None:
        rows = rows.where(F.col("relation_type").isin(relation_types))
    return rows.join(probes.select("node"), "node").select("node", "other").join(vertices.withColumnRenamed("id", "other"), "other")


def connected_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that have an edge; a loop is one."""
    return vertices.join(edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")), "id", "left_semi")


def remove_nodes(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes and the edges at them."""
    left = edges.join(gone.select(F.col("id").alias("subject_id")), "subject_id", "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.join(gone.select(F.col("id").alias("object_id")), "object_id", "left_anti")


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those between given pairs (``u, v``), in either direction."""
    own = gone.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return edges.withColumns({"u": F.least("subject_id", "object_id"), "v": F.greatest("subject_id", "object_id")}).join(own, ["u", "v"], "left_anti").drop("u", "v")


def implied_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices and, with only an id, the ends of edges that aren't among them."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return vertices.unionByName(ends.join(vertices, "id", "left_anti"), allowMissingColumns=True)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the least id of each node's component."""
    return connected_components(vertices.select("id"), edges, "id", "subject_id", "object_id")


def largest_component(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the component with most nodes (of equal ones, the one of the least id)."""
    own = materialize(components(vertices, edges))
    top = own.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    kept = own.join(F.broadcast(top.select("component")), "component", "left_semi").select("id")
    inside = edges.join(kept.select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    return vertices.join(kept, "id", "left_semi"), inside


def bfs(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``id, distance`` of nodes within ``depth`` edges of the seeds."""
    steps = both_ways(edges.where("subject_id <> object_id")).select("node", "other").distinct()
    seen = materialize(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        new = steps.join(front.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
        front = materialize(new.join(seen, "id", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front))
    return seen


def bfs_edges(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with a visited end, once, from the end that is nearer to the seeds (of equal ones, the least id) to the other."""
    rows = edges.where("subject_id <> object_id").select(*pair()).distinct()
    for side in ("u", "v"):
        rows = rows.join(visited.select(F.col("id").alias(side), F.col("distance").alias(f"d_{side}")), side, "left")
    rows = rows.where("d_u is not null or d_v is not null")
    forward = F.coalesce("d_u", F.lit(2**30)) <= F.coalesce("d_v", F.lit(2**30))
    return rows.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("dst"))


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``level, cluster_id, id`` of edges whose ends are in the same cluster of a level. ``members``: id, level, cluster_id."""
    a = members.select(F.col("id").alias("subject_id"), "level", "cluster_id")
    b = members.select(F.col("id").alias("object_id"), "level", "cluster_id")
    return edges.select("id", "subject_id", "object_id").join(a, "subject_id").join(b, ["object_id", "level", "cluster_id"]).select("level", "cluster_id", "id")


def assemble_communities(edges: DataFrame, members: DataFrame) -> DataFrame:
    """A record per cluster: its entities' and its relations' ids, sorted."""
    from graphloom.schemas import community_id

    nodes = members.groupBy("level", "cluster_id").agg(F.array_sort(F.collect_set("id")).alias("entity_ids"))
    links = community_edges(edges, members).groupBy("level", "cluster_id").agg(F.array_sort(F.collect_set("id")).alias("relation_ids"))
    none = F.array().cast("array<string>")
    out = nodes.join(links, ["level", "cluster_id"], "left").withColumn("relation_ids", F.coalesce("relation_ids", none))
    return out.select(community_id(F.col("level"), F.col("cluster_id")).alias("id"), "level", "cluster_id", "entity_ids", "relation_ids")
