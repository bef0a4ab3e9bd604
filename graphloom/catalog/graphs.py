"""Queries on the graph of the star schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.catalog import fixtures as X
from graphloom.catalog.registry import query, table
from graphloom.operators import graph as G
from graphloom.operators.communities import communities
from graphloom.plans.build import community_reports
from graphloom.plans.lineage import materialize
from graphloom.plans.triplets import allowed_types, validity
from graphloom.schemas import entity_id

WITH, RECURSIVE = f"WITH {X.GRAPH}", f"WITH RECURSIVE {X.GRAPH}"
ASIA = "'ent-' || md5('ASIA - REGION')"


def _asia(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(entity_id(F.lit("ASIA"), F.lit("REGION")).alias("id"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    return X.vertices(spark, d).where("entity_type in ('NATION', 'REGION')")


@query(f"{WITH} SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM edges UNION ALL SELECT object_id FROM edges) GROUP BY id")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of all nodes with edges."""
    return G.degrees(X.edges(spark, d))


@query(f"""{WITH}, deg AS (SELECT id, count(*) AS n FROM (SELECT subject_id AS id FROM edges UNION ALL SELECT object_id FROM edges) GROUP BY id)
SELECT e.id, a.n + b.n AS edge_degree FROM edges e JOIN deg a ON a.id = subject_id JOIN deg b ON b.id = object_id""")
def edge_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of all edges: the sum of their ends'."""
    return G.edge_degrees(X.edges(spark, d)).select("id", "edge_degree")


@query(f"{WITH} SELECT id FROM vertices WHERE id IN (SELECT subject_id FROM edges UNION SELECT object_id FROM edges)")
def isolated_removed(spark: SparkSession, d: str) -> DataFrame:
    """Vertices that have an edge."""
    return G.connected_nodes(X.vertices(spark, d), X.edges(spark, d)).select("id")


_NATIONS = "SELECT id FROM vertices WHERE entity_type = 'NATION'"


@query(f"""{WITH} SELECT 'node' AS kind, id FROM vertices WHERE id NOT IN ({_NATIONS})
UNION ALL SELECT 'edge', id FROM edges WHERE subject_id NOT IN ({_NATIONS}) AND object_id NOT IN ({_NATIONS})""")
def node_remove_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The graph without nations."""
    gone = X.vertices(spark, d).where("entity_type = 'NATION'").select("id")
    v, e = G.remove_nodes(X.vertices(spark, d), X.edges(spark, d), gone)
    return v.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query(f"{WITH} SELECT id FROM edges WHERE description <> 'part of'")
def edge_remove(spark: SparkSession, d: str) -> DataFrame:
    """The graph without the edges between nations and regions, given the other way round."""
    own = X.edges(spark, d)
    return G.remove_edges(own, own.where("description = 'part of'").select(F.col("object_id").alias("u"), F.col("subject_id").alias("v"))).select("id")


@query(f"""{WITH}, {X.BOTH}
SELECT b.id, node, n.entity_name AS subject_label, o.entity_name AS object_label, relation_strength FROM both_ways b
JOIN vertices n ON n.id = node JOIN vertices o ON o.id = other WHERE n.entity_type IN ('NATION', 'REGION')""")
def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges at all nations and regions, from their side."""
    rows = G.incident_edges(_places(spark, d).select(F.col("id").alias("node")), X.edges(spark, d), X.vertices(spark, d))
    return rows.select("id", "node", "subject_label", "object_label", "relation_strength")


@query(f"""{WITH}, {X.BOTH}
SELECT node, other, o.entity_name FROM both_ways JOIN vertices n ON n.id = node JOIN vertices o ON o.id = other WHERE n.entity_type IN ('NATION', 'REGION')""")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of all nations and regions."""
    rows = G.neighbours(_places(spark, d).select(F.col("id").alias("node")), X.edges(spark, d), X.vertices(spark, d))
    return rows.select("node", "other", "entity_name")


@query(f"{WITH} SELECT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v, min(id) AS id FROM edges GROUP BY 1, 2")
def edge_pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One edge per unordered pair, out of both orientations of all edges."""
    own = X.edges(spark, d)
    turned = own.select(F.concat(F.col("id"), F.lit("-turned")).alias("id"), F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"), "description", "relation_strength")
    return G.distinct_pairs(own.unionByName(turned))


@query(f"""{WITH}, pairs AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer, (SELECT DISTINCT s_nationkey FROM supplier)),
n AS (SELECT n_nationkey AS k, 'ent-' || md5(n_name || ' - NATION') AS id FROM nation), r AS (SELECT r_regionkey AS k, 'ent-' || md5(r_name || ' - REGION') AS id FROM region),
asked AS (SELECT n.id AS u, r.id AS v FROM n, r)
SELECT u, v, EXISTS (SELECT 1 FROM edges WHERE subject_id = u AND object_id = v) AS found FROM asked""")
def edge_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether each nation has an edge with each region, asked from the region."""
    v = X.vertices(spark, d)
    nations, regions = (v.where(F.col("entity_type") == k).select("id") for k in ("NATION", "REGION"))
    asked = regions.withColumnRenamed("id", "u").join(F.broadcast(nations.withColumnRenamed("id", "v")))  # 5 by 25 rows
    return G.has_edges(asked, X.edges(spark, d)).select(F.col("v").alias("u"), F.col("u").alias("v"), "found")


@query(f"{WITH} SELECT id, id IN (SELECT id FROM vertices WHERE entity_type <> 'PART') AS found FROM vertices")
def node_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether each vertex is in the graph without parts."""
    v = X.vertices(spark, d)
    return G.has_nodes(v.select("id"), v.where("entity_type <> 'PART'"))


@query(f"{WITH} SELECT id, CASE WHEN entity_type <> 'NATION' THEN entity_name END AS entity_name FROM vertices")
def implied_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Vertices other than nations, and what the edges imply."""
    v = X.vertices(spark, d)
    return G.implied_vertices(v.where("entity_type <> 'NATION'"), X.edges(spark, d)).select("id", "entity_name")


BFS = f"""{RECURSIVE}, {X.BOTH},
walk AS (SELECT {ASIA} AS id, 0 AS distance UNION SELECT b.other, w.distance + 1 FROM walk w JOIN both_ways b ON b.node = w.id WHERE w.distance < 2),
seen AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)"""


@query(f"{BFS} SELECT * FROM seen")
def bfs_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two edges of a region."""
    return G.bfs(_asia(spark), X.edges(spark, d), 2)


@query(f"""{BFS}, p AS (SELECT DISTINCT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v FROM edges WHERE subject_id <> object_id),
j AS (SELECT u, v, a.distance AS du, b.distance AS dv FROM p LEFT JOIN seen a ON a.id = u LEFT JOIN seen b ON b.id = v WHERE a.id IS NOT NULL OR b.id IS NOT NULL)
SELECT CASE WHEN coalesce(du, 99) <= coalesce(dv, 99) THEN u ELSE v END AS src, CASE WHEN coalesce(du, 99) <= coalesce(dv, 99) THEN v ELSE u END AS dst FROM j""")
def bfs_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with an end within two edges of a region."""
    own = X.edges(spark, d)
    return G.bfs_edges(G.bfs(_asia(spark), own, 2), own)


#: Components of what customers bought.
BOUGHT = f"""{RECURSIVE}, own AS (SELECT * FROM edges WHERE description = 'bought'), nodes AS (SELECT id FROM vertices WHERE entity_type IN ('CUSTOMER', 'PART')),
b AS (SELECT subject_id AS a, object_id AS o FROM own UNION SELECT object_id, subject_id FROM own),
reach AS (SELECT id AS a, id AS o FROM nodes UNION SELECT r.a, b.o FROM reach r JOIN b ON b.a = r.o),
comp AS (SELECT a AS id, min(o) AS component FROM reach GROUP BY a)"""


def _bought(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.vertices(spark, d).where("entity_type in ('CUSTOMER', 'PART')"), X.edges(spark, d).where("description = 'bought'")


@query(f"{BOUGHT} SELECT * FROM comp")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of customers and parts by what was bought; lone ones are their own."""
    return G.components(*_bought(spark, d))


@query(f"{BOUGHT}, top AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT id FROM comp WHERE component IN (SELECT component FROM top)")
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the largest of them."""
    return G.largest_component(*_bought(spark, d))[0].select("id")


#: Customers, suppliers and nations are in the cluster of their region.
MEMBERS = """members AS (
  SELECT 'ent-' || md5(c_name || ' - CUSTOMER') AS id, 0 AS level, n_regionkey AS cluster_id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'ent-' || md5(s_name || ' - SUPPLIER'), 0, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'ent-' || md5(n_name || ' - NATION'), 0, n_regionkey FROM nation)"""
INSIDE = f"""{WITH}, {MEMBERS}, inside AS (SELECT a.level, a.cluster_id, e.id FROM edges e JOIN members a ON a.id = subject_id JOIN members b ON b.id = object_id AND b.level = a.level AND b.cluster_id = a.cluster_id)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(entity_id(F.col("c_name"), F.lit("CUSTOMER")).alias("id"), "n_regionkey")
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(entity_id(F.col("s_name"), F.lit("SUPPLIER")).alias("id"), "n_regionkey")
    n = nation.select(entity_id(F.col("n_name"), F.lit("NATION")).alias("id"), "n_regionkey")
    return c.unionByName(s).unionByName(n).select("id", F.lit(0).alias("level"), F.col("n_regionkey").alias("cluster_id"))


@query(f"{INSIDE} SELECT * FROM inside")
def community_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges inside given clusters."""
    return G.community_edges(X.edges(spark, d), _members(spark, d))


@query(f"""{INSIDE}, n AS (SELECT level, cluster_id, md5(string_agg(id, ',' ORDER BY id)) AS entities, count(*) AS n_entities FROM members GROUP BY ALL),
e AS (SELECT level, cluster_id, md5(string_agg(id, ',' ORDER BY id)) AS relations FROM inside GROUP BY ALL)
SELECT 'com-' || md5(n.level || ' - ' || n.cluster_id) AS id, n.level, n.cluster_id, n_entities::INT AS n_entities, entities, coalesce(relations, md5('')) AS relations FROM n LEFT JOIN e USING (level, cluster_id)""")
def community_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Records of given clusters."""
    rows = G.assemble_communities(X.edges(spark, d), _members(spark, d))
    return rows.select("id", "level", "cluster_id", F.size("entity_ids").alias("n_entities"), F.md5(F.array_join("entity_ids", ",")).alias("entities"), F.md5(F.array_join("relation_ids", ",")).alias("relations"))


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, e = materialize(X.vertices(spark, d)), materialize(X.edges(spark, d))  # each is read several times
    return v, e, communities(v, e, most=200)


@query()
def hierarchical_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the whole graph, split until none has more than 200 members."""
    return _communities(spark, d)[2]


class ReportModel:
    """Writes reports that say how many entities and relations there are."""

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            entities, _, relations = p.partition("ENTITIES:\n")[2].partition("\nRELATIONS:\n")
            counts = [sum(1 for line in part.split("\n") if line) for part in (entities, relations)]
            out.append(json.dumps({"title": "Community", "summary": f"{counts[0]} entities, {counts[1]} relations", "rating": 5, "rating_explanation": "", "findings": []}))
        return out


@query()
def community_report(spark: SparkSession, d: str) -> DataFrame:
    """A report on each community, by model calls (here a stand-in that counts the lines it is given)."""
    v, e, members = _communities(spark, d)
    members = materialize(members)
    names = v.select("id", "entity_name")
    s, o = (names.select(F.col("id").alias(f"{k}_id"), F.col("entity_name").alias(f"{k}_name")) for k in ("subject", "object"))
    return community_reports(G.assemble_communities(e, members), v, e.join(s, "subject_id").join(o, "object_id"), ReportModel())


TYPES = f"""{WITH}, allowed AS (SELECT DISTINCT e.description AS relation, a.entity_type AS subject_type, b.entity_type AS object_type FROM edges e JOIN vertices a ON a.id = subject_id JOIN vertices b ON b.id = object_id)"""


@query(f"{TYPES} SELECT * FROM allowed")
def relation_type_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Between which types each relation is known."""
    return allowed_types(X.edges(spark, d), X.vertices(spark, d))


@query(f"""{TYPES}, asked AS (SELECT e.id, e.description AS relation, b.entity_type AS subject_type, a.entity_type AS object_type FROM edges e JOIN vertices a ON a.id = subject_id JOIN vertices b ON b.id = object_id
  UNION ALL SELECT e.id, e.description, a.entity_type, b.entity_type FROM edges e JOIN vertices a ON a.id = subject_id JOIN vertices b ON b.id = object_id)
SELECT id, relation, subject_type, object_type, EXISTS (SELECT 1 FROM allowed w WHERE w.relation = k.relation AND w.subject_type = k.subject_type AND w.object_type = k.object_type) AS validity FROM asked k""")
def triplet_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each edge, and each edge turned round, is between known types."""
    v, e = X.vertices(spark, d).select("id", "entity_type"), X.edges(spark, d)
    s, o = (v.select(F.col("id").alias(f"{k}_id"), F.col("entity_type").alias(f"{k}_type")) for k in ("subject", "object"))
    rows = e.join(s, "subject_id").join(o, "object_id").select("id", F.col("description").alias("relation"), "subject_type", "object_type")
    turned = rows.select("id", "relation", F.col("object_type").alias("subject_type"), F.col("subject_type").alias("object_type"))
    return validity(rows.unionByName(turned), allowed_types(e, X.vertices(spark, d)))
