"""Queries on grouping, upserts and key-value operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.catalog import fixtures as X
from graphloom.catalog.registry import query, table
from graphloom.operators import keyed, merging
from graphloom.schemas import entity_id

#: Parts as mentions of entities: a brand of a type, described by part names.
PARTS = """SELECT p_brand AS entity_name, p_type AS entity_type, p_name AS description, 'size-' || p_size AS chunk, 'doc-' || (p_size % 7) AS doc, p_partkey AS pos FROM part"""
GROUPED = f"""WITH e AS ({PARTS})
SELECT 'ent-' || md5(entity_name || ' - ' || entity_type) AS id, entity_name, entity_type, count(description) AS duplicate_count,
       md5(string_agg(description, '. ' ORDER BY pos)) AS hash, array_to_string(list_sort(list_distinct(list(chunk))), ',') AS sources,
       array_to_string(list_sort(list_distinct(list(doc))), ',') AS docs FROM e GROUP BY entity_name, entity_type"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.col("p_brand").alias("entity_name"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"), F.array(F.concat(F.lit("size-"), "p_size")).alias("source_chunk_id"), F.array(F.concat(F.lit("doc-"), F.col("p_size") % 7)).alias("documents_id"), F.col("p_partkey").alias("pos"))


def _grouped(df: DataFrame) -> DataFrame:
    return df.select("id", "entity_name", "entity_type", "duplicate_count", F.md5("description").alias("hash"), F.array_join("source_chunk_id", ",").alias("sources"), F.array_join("documents_id", ",").alias("docs"))


@query(GROUPED)
def entity_group(spark: SparkSession, d: str) -> DataFrame:
    """Mentions grouped by name and type."""
    return _grouped(merging.group_entities(_mentions(spark, d)))


STRICT = """SELECT 'balance ' || floor(c_acctbal)::BIGINT AS entity_name, c_mktsegment AS entity_type, count(*) AS duplicate_count, min(c_name) AS description FROM customer
GROUP BY 1, 2 HAVING count(*) = 1"""


@query(STRICT)
def entity_group_strict(spark: SparkSession, d: str) -> DataFrame:
    """Customers by segment and whole balance, without a model and strictly: what occurs more than once is dropped."""
    name = F.concat(F.lit("balance "), F.floor("c_acctbal").cast("long"))
    rows = table(spark, d, "customer").select(name.alias("entity_name"), F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("description"), F.col("c_custkey").alias("pos"), F.array("c_name").alias("source_chunk_id"), F.array("c_name").alias("documents_id"))
    return merging.summarised(merging.group_entities(rows), F.lit(""), None, strict=True).select("entity_name", "entity_type", "duplicate_count", "description")


@query("""SELECT c_mktsegment AS entity_type, count(*) AS duplicate_count, 'merged ' || count(*) AS description FROM customer GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT c_mktsegment, count(*), min(c_name) FROM customer GROUP BY 1 HAVING count(*) = 1""")
def entity_group_model(spark: SparkSession, d: str) -> DataFrame:
    """Customers as descriptions of their segment, which a model (here one that counts them) makes one."""
    rows = table(spark, d, "customer").select(F.lit("segment").alias("entity_name"), F.col("c_mktsegment").alias("entity_type"), F.regexp_replace("c_name", r"\\.", "").alias("description"), F.col("c_custkey").alias("pos"), F.array("c_name").alias("source_chunk_id"), F.array("c_name").alias("documents_id"))
    prompt = F.concat(F.lit("Merge:"), "description")
    told = merging.summarised(merging.group_entities(rows), prompt, lambda ps: [f"merged {p.count('. ') + 1}" for p in ps])
    return told.select("entity_type", "duplicate_count", "description")


#: Order lines as relations of customers with suppliers.
LINES = """r AS (SELECT 'c' || o_custkey AS subject_id, 's' || l_suppkey AS object_id, l_returnflag || l_linestatus AS description, l_quantity AS q, 'o' || l_orderkey AS chunk, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s, o = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    return rows.select(s.alias("subject_id"), o.alias("object_id"), s.alias("subject_name"), o.alias("object_name"), F.concat("l_returnflag", "l_linestatus").alias("description"), F.col("l_quantity").alias("relation_strength"), F.array(F.concat(F.lit("o"), "l_orderkey")).alias("source_chunk_id"), F.struct("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("d"), "l_quantity").alias("pos"))


@query(f"""WITH {LINES}
SELECT 'rel-' || md5(subject_id || ' -> ' || object_id) AS id, subject_id AS subject_name, md5(string_agg(description, chr(10) ORDER BY l_orderkey, l_linenumber, description, q)) AS hash, round(avg(q), 6) AS strength,
       md5(array_to_string(list_sort(list_distinct(list(chunk))), ',')) AS sources, count(*) AS duplicate_count FROM r GROUP BY subject_id, object_id""")
def relation_group(spark: SparkSession, d: str) -> DataFrame:
    """Relations grouped by their directed pair."""
    rows = merging.group_relations(_lines(spark, d))
    return rows.select("id", "subject_name", F.md5("description").alias("hash"), F.round("relation_strength", 6).alias("strength"), F.md5(F.array_join("source_chunk_id", ",")).alias("sources"), "duplicate_count")


@query(f"""WITH {LINES}
SELECT subject_id, object_id, round(list_reduce(list(q ORDER BY l_orderkey, l_linenumber, description, q), lambda a, b: (a + b) * 0.5), 6) AS strength,
       string_agg(description, '' ORDER BY l_orderkey, l_linenumber, description, q) AS description FROM r GROUP BY subject_id, object_id""")
def relation_merge_running_mean(spark: SparkSession, d: str) -> DataFrame:
    """Relations of a pair upserted one after the other."""
    return merging.running_mean(_lines(spark, d)).select("subject_id", "object_id", F.round("relation_strength", 6).alias("strength"), "description")


@query("""WITH o AS (SELECT c_name, o_orderpriority, o_orderkey, 'o' || o_orderkey AS chunk FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'ent-' || md5(c_name || ' - CUSTOMER') AS id, c_mktsegment || coalesce(string_agg(o_orderpriority, '' ORDER BY o_orderkey), '') AS description,
       md5(array_to_string(list_sort(list_distinct(list_concat(['seed'], list(chunk) FILTER (chunk IS NOT NULL)))), ',')) AS sources
FROM customer LEFT JOIN o USING (c_name) GROUP BY c_name, c_mktsegment""")
def entity_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entities, with their orders merged into them."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    none = F.array().cast("array<string>")

    def entity(rows: DataFrame, text: str, sources, pos) -> DataFrame:
        no_clusters = F.array().cast("array<struct<level:int,cluster_id:int>>")
        return rows.select(entity_id(F.col("c_name"), F.lit("CUSTOMER")).alias("id"), F.col("c_name").alias("entity_name"), F.lit("CUSTOMER").alias("entity_type"), F.col(text).alias("description"), sources.alias("source_chunk_id"), none.alias("documents_id"), no_clusters.alias("clusters"), pos.alias("pos"))

    old = entity(customer, "c_mktsegment", F.array(F.lit("seed")), F.lit(0).cast("long"))
    new = entity(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), "o_orderpriority", F.array(F.concat(F.lit("o"), "o_orderkey")), F.col("o_orderkey"))
    return merging.merge_entities(old, new).select("id", "description", F.md5(F.array_join("source_chunk_id", ",")).alias("sources"))


@query("""SELECT c_custkey AS id, coalesce(last, c_acctbal) AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Balances overwritten by each customer's last order."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(-1).cast("long").alias("at"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("at"))
    return keyed.upsert(old, new, "id", "at").select("id", "value")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def kv_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Parts that nobody bought fifty of, each asked for twice."""
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return keyed.missing_keys(table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id")), asked.unionByName(asked))


@query("SELECT o_orderkey AS pos, o_custkey AS id, c_name, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def kv_get_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Some fields of the customer of each order."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return keyed.get_by_ids(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), asked, ["c_name", "c_acctbal"])


@query(f"WITH {X.VERTICES} SELECT id, description FROM vertices WHERE id = 'ent-' || md5('ASIA - REGION')")
def kv_get_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One record by its key."""
    own = spark.range(1).select(entity_id(F.lit("ASIA"), F.lit("REGION")).alias("id")).first()[0]
    return keyed.get_by_id(X.vertices(spark, d), own).select("id", "description")


@query("SELECT c_custkey AS id FROM customer")
def kv_all_keys(spark: SparkSession, d: str) -> DataFrame:
    """All keys."""
    return keyed.all_keys(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"))
