"""Queries on retrieval over the graph whose entities have vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.catalog import fixtures as X
from graphloom.catalog.registry import query, table
from graphloom.plans import search as S
from graphloom.plans.lineage import materialize
from graphloom.schemas import community_id
from graphloom.streaming.incremental import upsert_stream

WITH = f"WITH {X.VECTOR_GRAPH}"


def _graph(spark: SparkSession, d: str) -> S.Graph:
    entities, links, chunks = X.vector_graph(spark, d)
    return S.Graph(entities.drop("vector"), links, chunks, entities.select("id", "vector"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return S.hits_of(_graph(spark, d), X.probe_of(spark, d))


@query(f"{WITH} SELECT id, entity_name, entity_type, description, rank::INT AS rank FROM hits")
def local_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the vectors nearest to a probe."""
    return _hits(spark, d).select("id", "entity_name", "entity_type", "description", "rank")


RELATIONS = """rels AS (SELECT l.*, h.entity_name AS subject_label, o.entity_name AS object_label, h.rank AS hit_rank,
  row_number() OVER (ORDER BY relation_strength DESC, h.rank, l.id) AS position FROM links_both l JOIN hits h ON h.id = l.node JOIN entities o ON o.id = l.other)"""
CHUNKS = """cited AS (SELECT DISTINCT id AS node, rank, unnest(source_chunk_id) AS chunk_id FROM hits),
firsts AS (SELECT * FROM cited QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY rank) = 1),
theirs AS (SELECT id AS other, unnest(list_distinct(source_chunk_id)) AS chunk_id FROM entities),
counts AS (SELECT l.node, t.chunk_id, count(*) AS n FROM links_both l JOIN theirs t ON t.other = l.other GROUP BY ALL),
texts AS (SELECT f.chunk_id, f.rank AS "order", coalesce(n, 0) AS relation_counts, text AS content FROM firsts f LEFT JOIN counts USING (node, chunk_id) JOIN documents ON 'c' || doc_id = f.chunk_id)"""


@query(f"{WITH}, {RELATIONS} SELECT id, node, subject_label, object_label, relation_strength, position::INT AS position FROM rels")
def local_relations(spark: SparkSession, d: str) -> DataFrame:
    """Their edges, strongest first."""
    return S.ranked_relations(_hits(spark, d), _graph(spark, d)).select("id", "node", "subject_label", "object_label", "relation_strength", "position")


@query(f'{WITH}, {CHUNKS} SELECT chunk_id, "order"::INT AS "order", relation_counts, md5(content) AS hash FROM texts')
def local_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The texts that they cite, with what ranks them."""
    return S.ranked_chunks(_hits(spark, d), _graph(spark, d)).select("chunk_id", "order", "relation_counts", F.md5("content").alias("hash"))


@query(f"""{WITH}, {RELATIONS}, {CHUNKS},
a AS (SELECT string_agg(entity_name || ', ' || entity_type || ', ' || description, chr(10) ORDER BY rank) AS t FROM hits),
b AS (SELECT string_agg(subject_label || ', ' || object_label || ', ' || description || ', ' || CASE WHEN relation_strength = floor(relation_strength) THEN relation_strength::INT || '.0' ELSE relation_strength::DOUBLE::VARCHAR END, chr(10) ORDER BY position) AS t FROM rels),
c AS (SELECT string_agg(content, chr(10) ORDER BY "order", relation_counts DESC, chunk_id) AS t FROM texts)
SELECT md5('Entities' || chr(10) || a.t || chr(10) || chr(10) || 'Relations' || chr(10) || b.t || chr(10) || chr(10) || 'Texts' || chr(10) || c.t) AS hash FROM a, b, c""")
def context_render(spark: SparkSession, d: str) -> DataFrame:
    """The context of an answer, rendered."""
    g, hits = _graph(spark, d), materialize(_hits(spark, d))
    return S.local_context(hits, S.ranked_relations(hits, g), S.ranked_chunks(hits, g)).select(F.md5("context").alias("hash"))


#: What reports said to a question: one for each labelled document, rated by its labels.
INSIGHTS = """insights AS (SELECT doc_id AS pos, 'report ' || doc_id AS response, quality * 6 + toxic * 2 + (doc_id % 10) * 0.09::DOUBLE AS rating FROM labels),
ranked AS (SELECT *, row_number() OVER (ORDER BY trunc(rating)::INT DESC, pos) AS rank FROM insights WHERE trunc(rating)::INT > 0)"""


def _insights(spark: SparkSession, d: str) -> DataFrame:
    rating = (F.col("quality") * 6 + F.col("toxic") * 2).cast("double") + (F.col("doc_id") % 10) * F.lit(0.09)
    return S.ranked_insights(table(spark, d, "labels").select(F.col("doc_id").alias("pos"), F.concat(F.lit("report "), "doc_id").alias("response"), rating.alias("rating")))


@query(f"WITH {INSIGHTS} SELECT pos, response, round(rating, 6) AS rating, rank::INT AS rank FROM ranked")
def global_rank(spark: SparkSession, d: str) -> DataFrame:
    """Insights that help, best first."""
    return _insights(spark, d).select("pos", "response", F.round("rating", 6).alias("rating"), "rank")


@query(f"WITH {INSIGHTS} SELECT count(*) AS n_lines, md5(string_agg(rank || '. Insight: ' || response, chr(10) ORDER BY rank)) AS hash FROM ranked")
def insight_render(spark: SparkSession, d: str) -> DataFrame:
    """The numbered insights as text (compared without the digits of ratings)."""
    own = S.insight_context(_insights(spark, d)).select(F.explode(F.split("text", "\n")).alias("line"))
    cut = own.select(F.regexp_replace("line", ", rating: .*$", "").alias("line"), F.regexp_extract("line", r"^(\d+)", 1).cast("int").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda p: p["line"])
    return cut.agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(pairs, "\n")).alias("hash"))


@query(f"""{WITH}, members AS (SELECT 'v' || vec_id AS id, label % 4 AS level, label AS cluster_id FROM embeddings),
own AS (SELECT level, cluster_id, count(*) AS n_hits FROM members JOIN hits USING (id) WHERE level <= 2 GROUP BY ALL)
SELECT 'com-' || md5(level || ' - ' || cluster_id) AS id, level::INT AS level, n_hits, 'summary ' || cluster_id AS summary FROM own""")
def community_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the communities (here labels) that the hits are in, up to level 2."""
    members = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), (F.col("label") % 4).alias("level"), F.col("label").alias("cluster_id"))
    g = _graph(spark, d)
    g.members = members
    g.summaries = members.select("level", "cluster_id").distinct().select(community_id(F.col("level"), F.col("cluster_id")).alias("id"), F.concat(F.lit("summary "), "cluster_id").alias("summary"))
    return S.related_summaries(_hits(spark, d), g)


@query("SELECT user_id, max(event_id) AS last_event, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, by upserts of a stream's micro-batches into a stored table."""
    from graphloom.plans.lineage import checkpoint_folder

    folder = f"{checkpoint_folder(spark)}/stream-upsert-{uuid.uuid4().hex}"
    kind = table(spark, d, "events").schema
    state = {"now": spark.createDataFrame([], "user_id long, last_event long, value double")}

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        state["now"] = spark.read.parquet(f"{folder}/batch-{number}")

    events = spark.readStream.schema(kind).parquet(f"{d}/events.parque[t]").select("user_id", F.col("event_id").alias("last_event"), "value")
    upsert_stream(events, lambda: state["now"], save, f"{folder}/checkpoint", "user_id", "last_event").awaitTermination()
    return state["now"]
