"""Queries on extraction from chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.catalog.registry import query, table
from graphloom.functions import text as T
from graphloom.operators import extraction as E
from graphloom.providers import RuleModel
from graphloom.schemas import entity_id

#: Answers of a small model, by turn, and what is kept of each.
ANSWERS = (("", None), ("-", None), ("—", None), ("Нет связи", None), ("Отсутствует отношение", None), ("В тексте нет связи", "В тексте нет связи"), ("- брат", "брат"), ("• работает в", "работает в"), ("нет данных о них", None))
_KEPT = " ".join(f"WHEN {i} THEN {'NULL' if kept is None else repr(kept)}" for i, (_, kept) in enumerate(ANSWERS))


@query(f"SELECT * FROM (SELECT doc_id, CASE doc_id % {len(ANSWERS)} {_KEPT} END AS description FROM documents) WHERE description IS NOT NULL")
def relation_negation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Answers on relations, one for each document, without those that deny one."""
    said = F.array(*[F.lit(a) for a, _ in ANSWERS])
    rows = table(spark, d, "documents").select("doc_id", T.relation_text(F.get(said, (F.col("doc_id") % len(ANSWERS)).cast("int"))).alias("description"))
    return rows.where("description is not null")


#: Orders as chunks; their lines are entities, and each claims three relations.
ORDERS = """ents AS (SELECT l_orderkey AS chunk_id, l_linenumber AS pos, l_returnflag AS name, 'ent-' || md5(l_returnflag || ' - ' || l_linestatus) AS id FROM lineitem),
known AS (SELECT chunk_id, name, arg_min(id, pos) AS id FROM ents GROUP BY ALL),
rels AS (SELECT o_orderkey AS chunk_id, unnest(['A', 'N', 'R', '']) AS s, unnest(['N', 'R', 'Z', 'N']) AS o FROM orders)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("entity_name"), F.col("l_linestatus").alias("entity_type"), entity_id(F.col("l_returnflag"), F.col("l_linestatus")).alias("id"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The entities in the order of their lines, those of equal number in the order of the files, which SQL reads them in."""
    rows = table(spark, d, "lineitem").select("*", F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("pos"))
    return rows.select(F.col("l_orderkey").alias("chunk_id"), "pos", F.col("l_returnflag").alias("entity_name"), entity_id(F.col("l_returnflag"), F.col("l_linestatus")).alias("id"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(o).alias("o")) for s, o in (("A", "N"), ("N", "R"), ("R", "Z"), ("", "N"))])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.explode(pairs).alias("p"))
    return rows.select("chunk_id", F.col("p.s").alias("subject_name"), F.col("p.o").alias("object_name"), F.lit(None).cast("int").alias("relation_strength"))


@query(f"""WITH {ORDERS}
SELECT r.chunk_id, a.id AS subject_id, b.id AS object_id, 'rel-' || md5(a.id || ' -> ' || b.id) AS id, 1.0::DOUBLE AS relation_strength
FROM rels r JOIN known a ON a.chunk_id = r.chunk_id AND a.name = r.s JOIN known b ON b.chunk_id = r.chunk_id AND b.name = r.o""")
def endpoint_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all orders with the entities that their ends mean."""
    rows = E.resolve_endpoints(_placed(spark, d), _relations(spark, d))
    return rows.select("chunk_id", "subject_id", "object_id", "id", "relation_strength")


@query(f"""WITH {ORDERS}, names AS (SELECT DISTINCT chunk_id, name FROM ents)
SELECT r.chunk_id, r.s AS subject_name, r.o AS object_name FROM rels r
WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.chunk_id = r.chunk_id AND n.name = r.s) OR NOT EXISTS (SELECT 1 FROM names n WHERE n.chunk_id = r.chunk_id AND n.name = r.o)""")
def dangling_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all orders with an end that the order doesn't have."""
    return E.dangling(_entities(spark, d), _relations(spark, d)).select("chunk_id", "subject_name", "object_name")


@query("SELECT a.l_orderkey AS chunk_id, a.l_linenumber AS subject_pos, b.l_linenumber AS object_pos FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber")
def pair_permutations(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of the entities of each chunk."""
    return E.ordered_pairs(_entities(spark, d).withColumnRenamed("entity_name", "name")).select("chunk_id", "subject_pos", "object_pos")


MENTIONS = "regexp_extract_all(text, '[A-Z][a-z]{3,}')"


@query(f"SELECT doc_id, m AS mention, count(*) AS n FROM (SELECT doc_id, unnest({MENTIONS}) AS m FROM documents) GROUP BY ALL")
def document_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words of each document, with their counts."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.mentions(F.col("text"))).alias("mention"))
    return rows.groupBy("doc_id", "mention").agg(F.count(F.lit(1)).alias("n"))


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    return E.extract(chunks, RuleModel())


@query(f"SELECT DISTINCT doc_id::VARCHAR AS doc_id, 'ent-' || md5(m || ' - TERM') AS id, m AS entity_name FROM (SELECT doc_id, unnest({MENTIONS}) AS m FROM documents)")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all documents by a model call for each (here a deterministic stand-in)."""
    return _extracted(spark, d)[0].select("doc_id", "id", "entity_name")


@query(f"""WITH m AS (SELECT doc_id, unnest(l) AS m, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, {MENTIONS} AS l FROM documents)),
f AS (SELECT doc_id, m, min(p) AS p FROM m GROUP BY ALL),
n AS (SELECT doc_id, m, lead(m) OVER (PARTITION BY doc_id ORDER BY p) AS o FROM f)
SELECT doc_id::VARCHAR AS chunk_id, m AS subject_name, o AS object_name, 'rel-' || md5('ent-' || md5(m || ' - TERM') || ' -> ' || 'ent-' || md5(o || ' - TERM')) AS id FROM n WHERE o IS NOT NULL""")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all documents by the same calls."""
    return _extracted(spark, d)[1].select("chunk_id", "subject_name", "object_name", "id")
