"""Graphs over the star schema and the vectors, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.catalog.registry import table
from graphloom.schemas import entity_id, relation_id

#: Every customer, supplier, part, nation and region is an entity.
VERTICES = """vertices AS (
  SELECT 'ent-' || md5(entity_name || ' - ' || entity_type) AS id, * FROM (
    SELECT c_name AS entity_name, 'CUSTOMER' AS entity_type, c_mktsegment AS description FROM customer
    UNION ALL SELECT s_name, 'SUPPLIER', 'nation ' || s_nationkey FROM supplier
    UNION ALL SELECT 'Part ' || p_partkey, 'PART', p_type FROM part
    UNION ALL SELECT n_name, 'NATION', 'region ' || n_regionkey FROM nation
    UNION ALL SELECT r_name, 'REGION', 'region' FROM region))"""

#: Customers and suppliers are located in nations, nations are part of regions, customers bought parts in bulk at the top discounts.
EDGES = """raw_edges AS (
  SELECT 'ent-' || md5(c_name || ' - CUSTOMER') AS subject_id, 'ent-' || md5(n_name || ' - NATION') AS object_id, 'located in' AS description, 1.0::DOUBLE AS relation_strength
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'ent-' || md5(s_name || ' - SUPPLIER'), 'ent-' || md5(n_name || ' - NATION'), 'located in', 1.5 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'ent-' || md5(n_name || ' - NATION'), 'ent-' || md5(r_name || ' - REGION'), 'part of', 2.0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'ent-' || md5(c_name || ' - CUSTOMER'), 'ent-' || md5('Part ' || l_partkey || ' - PART'), 'bought', max(l_extendedprice)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity = 50 AND l_discount >= 0.09 GROUP BY 1, 2),
edges AS (SELECT 'rel-' || md5(subject_id || ' -> ' || object_id) AS id, * FROM raw_edges)"""

GRAPH = f"{VERTICES},\n{EDGES}"

BOTH = """both_ways AS (
  SELECT *, subject_id AS node, object_id AS other FROM edges
  UNION ALL SELECT *, object_id, subject_id FROM edges WHERE subject_id <> object_id)"""


def vertices(spark: SparkSession, d: str) -> DataFrame:
    own = {
        "customer": ("c_name", "CUSTOMER", "c_mktsegment"),
        "supplier": ("s_name", "SUPPLIER", "concat('nation ', s_nationkey)"),
        "part": ("concat('Part ', p_partkey)", "PART", "p_type"),
        "nation": ("n_name", "NATION", "concat('region ', n_regionkey)"),
        "region": ("r_name", "REGION", "'region'"),
    }
    out = None
    for t, (name, kind, text) in own.items():
        rows = table(spark, d, t).selectExpr(f"{name} AS entity_name", f"'{kind}' AS entity_type", f"{text} AS description")
        out = rows if out is None else out.unionByName(rows)
    return out.select(entity_id(F.col("entity_name"), F.col("entity_type")).alias("id"), "entity_name", "entity_type", "description")


def edges(spark: SparkSession, d: str) -> DataFrame:
    customer, supplier, nation, region = (table(spark, d, t) for t in ("customer", "supplier", "nation", "region"))
    c, s, n, r, p = (entity_id(name, F.lit(kind)) for name, kind in ((F.col("c_name"), "CUSTOMER"), (F.col("s_name"), "SUPPLIER"), (F.col("n_name"), "NATION"), (F.col("r_name"), "REGION"), (F.concat(F.lit("Part "), "l_partkey"), "PART")))

    def rows(df: DataFrame, a, b, text: str, strength) -> DataFrame:
        return df.select(a.alias("subject_id"), b.alias("object_id"), F.lit(text).alias("description"), strength.cast("double").alias("relation_strength"))

    lines = table(spark, d, "lineitem").where("l_quantity = 50 and l_discount >= 0.09").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = rows(lines.join(customer, F.col("o_custkey") == F.col("c_custkey")), c, p, "bought", F.col("l_extendedprice"))
    out = rows(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), c, n, "located in", F.lit(1.0))
    out = out.unionByName(rows(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), s, n, "located in", F.lit(1.5)))
    out = out.unionByName(rows(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), n, r, "part of", F.lit(2.0)))
    out = out.unionByName(bought.groupBy("subject_id", "object_id", "description").agg(F.max("relation_strength").alias("relation_strength")))
    return out.select(relation_id(F.col("subject_id"), F.col("object_id")).alias("id"), "*")


#: A graph whose entities have vectors: entity v has the vector of number v, cites two documents' texts, and leads to entity 3 v + 1 (modulo their number).
VECTOR_GRAPH = """sizes AS (SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM documents) AS m),
entities AS (
  SELECT 'v' || vec_id AS id, 'entity ' || vec_id AS entity_name, 'L' || label AS entity_type, 'about ' || (vec_id % 13) AS description, embedding AS vector, vec_id,
         ['c' || (vec_id % m), 'c' || ((vec_id * 7 + 1) % m), 'missing'] AS source_chunk_id FROM embeddings, sizes),
links AS (
  SELECT 'r' || vec_id AS id, 'v' || vec_id AS subject_id, 'v' || ((vec_id * 3 + 1) % n) AS object_id, 'leads to' AS description,
         (1 + (vec_id * 7) % 5)::DOUBLE + 0.5::DOUBLE * (vec_id % 2) AS relation_strength FROM embeddings, sizes),
links_both AS (
  SELECT *, subject_id AS node, object_id AS other FROM links UNION ALL SELECT *, object_id, subject_id FROM links WHERE subject_id <> object_id),
probe AS (SELECT embedding AS p FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (SELECT e.*, list_cosine_similarity(vector::DOUBLE[], p::DOUBLE[]) AS score FROM entities e, probe),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 20),
hits AS (SELECT * FROM best WHERE score >= 0.2)"""


def vector_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (with vectors), their links, and chunks: the documents."""
    vectors, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    sizes = vectors.agg(F.count(F.lit(1)).alias("n")).join(docs.agg(F.count(F.lit(1)).alias("m")))  # one row
    rows = vectors.join(F.broadcast(sizes))
    v = F.col("vec_id")
    chunks = F.array(F.concat(F.lit("c"), v % F.col("m")), F.concat(F.lit("c"), (v * 7 + 1) % F.col("m")), F.lit("missing"))
    entities = rows.select(F.concat(F.lit("v"), v).alias("id"), F.concat(F.lit("entity "), v).alias("entity_name"), F.concat(F.lit("L"), "label").alias("entity_type"), F.concat(F.lit("about "), v % 13).alias("description"), F.col("embedding").alias("vector"), "vec_id", chunks.alias("source_chunk_id"))
    strength = (1 + (v * 7) % 5).cast("double") + 0.5 * (v % 2)
    links = rows.select(F.concat(F.lit("r"), v).alias("id"), F.concat(F.lit("v"), v).alias("subject_id"), F.concat(F.lit("v"), (v * 3 + 1) % F.col("n")).alias("object_id"), F.lit("leads to").alias("description"), strength.alias("relation_strength"))
    return entities, links, docs.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("text").alias("content"))


def probe_of(spark: SparkSession, d: str) -> list[float]:
    """The first vector."""
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])
