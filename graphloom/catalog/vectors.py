"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from graphloom.catalog import fixtures as X
from graphloom.catalog.registry import query, table
from graphloom.operators.chunking import neighbour_similarity
from graphloom.operators.clustering import density_clusters
from graphloom.operators.similarity import candidates, similar_relations, similar_to, top_k, top_k_by_probe

WITH = f"WITH {X.VECTOR_GRAPH}"


def _scores(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "rank")


@query(f"{WITH} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM best")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 vectors nearest to the first one."""
    return _scores(top_k(X.vector_graph(spark, d)[0], X.probe_of(spark, d), 20))


@query(f"{WITH} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hits")
def vector_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Those of them with a cosine of 0.2 or more."""
    return _scores(top_k(X.vector_graph(spark, d)[0], X.probe_of(spark, d), 20, 0.2))


@query(f"""{WITH}, soft AS (SELECT id, list_dot_product(vector::DOUBLE[], p::DOUBLE[]) / ((sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) + 1e-8) * (sqrt(list_dot_product(p::DOUBLE[], p::DOUBLE[])) + 1e-8)) AS s FROM entities, probe)
SELECT id, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, id))::INT AS rank FROM soft QUALIFY rank <= 10""")
def vector_topk_soft(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest by the cosine that allows for zero vectors."""
    return _scores(top_k(X.vector_graph(spark, d)[0], X.probe_of(spark, d), 10, soft=True))


@query(f"{WITH} SELECT id, entity_name, round(score, 6) AS score FROM best WHERE rank <= 6 AND vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY rank LIMIT 5")
def similar_entities(spark: SparkSession, d: str) -> DataFrame:
    """The 5 entities most like the first one, other than it."""
    entities = X.vector_graph(spark, d)[0]
    own = entities.orderBy("vec_id").select("id").first()[0]
    rows = similar_to(entities, own, X.probe_of(spark, d), entities.select("id", "entity_name"), 5)
    return rows.select("id", "entity_name", F.round("score", 6).alias("score"))


@query(f"""{WITH}, rv AS (SELECT l.id, subject_id AS s, object_id AS o, score FROM links l JOIN scored e ON e.id = l.subject_id),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM rv QUALIFY rank <= 6),
own AS (SELECT 'r' || min(vec_id) AS id FROM embeddings)
SELECT l.id, round(score, 6) AS score FROM top t JOIN links l ON least(l.subject_id, l.object_id) = least(s, o) AND greatest(l.subject_id, l.object_id) = greatest(s, o)
WHERE t.id <> (SELECT id FROM own) AND l.id <> (SELECT id FROM own) ORDER BY rank, l.id LIMIT 5""")
def similar_relation_rows(spark: SparkSession, d: str) -> DataFrame:
    """The 5 relations most like the first one, each with the vector of its subject."""
    entities, links, _ = X.vector_graph(spark, d)
    own = entities.orderBy("vec_id").select(F.concat(F.lit("r"), "vec_id")).first()[0]
    rv = links.join(entities.select(F.col("id").alias("subject_id"), "vector"), "subject_id").select("id", F.col("subject_id").alias("subject"), F.col("object_id").alias("object"), "vector")
    return similar_relations(rv, own, X.probe_of(spark, d), links, 5).select("id", F.round("score", 6).alias("score"))


PROBES = """probes AS (SELECT label, arg_min(embedding, vec_id) AS p FROM embeddings GROUP BY label),
near AS (SELECT 'label ' || label AS probe_id, id, list_cosine_similarity(vector::DOUBLE[], p::DOUBLE[]) AS score FROM entities, probes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5)"""


def _probes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("probe"))
    return own.select(F.concat(F.lit("label "), "label").alias("probe_id"), "probe")


@query(f"{WITH}, {PROBES} SELECT probe_id, id, round(score, 6) AS score, rank::INT AS rank FROM ranked")
def query_candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 vectors nearest to each label's first."""
    rows = top_k_by_probe(_probes(spark, d), X.vector_graph(spark, d)[0], 5)
    return rows.select("probe_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""{WITH}, {PROBES}, n AS (SELECT probe_id AS term, string_agg(entity_name, ', ' ORDER BY rank) AS candidates FROM ranked r JOIN entities e ON e.id = r.id WHERE score < 1.5 GROUP BY 1)
SELECT term, candidates FROM n UNION ALL SELECT 'no label', 'no label'""")
def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    """Candidate names for each label and for a term that has none."""
    entities = X.vector_graph(spark, d)[0]
    found = top_k_by_probe(_probes(spark, d), entities, 5).join(entities.select("id", F.col("entity_name").alias("name")), "id").select(F.col("probe_id").alias("term"), "rank", "name")
    terms = _probes(spark, d).select(F.col("probe_id").alias("term")).unionByName(spark.range(1).select(F.lit("no label").alias("term")))
    return candidates(terms, found).select("term", F.array_join("candidates", ", ").alias("candidates"))


@query("""WITH n AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings)
SELECT label AS doc_id, vec_id AS pos, round(list_dot_product(a, b), 6) AS near FROM n WHERE b IS NOT NULL""")
def sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of consecutive vectors of each label."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return neighbour_similarity(rows).select("doc_id", "pos", F.round("near", 6).alias("near"))


@query("""WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.label, a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= 1.0),
r AS (SELECT label, x, x AS y FROM (SELECT DISTINCT label, x FROM l) UNION SELECT r.label, r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT label, x, min(y) AS least FROM r GROUP BY ALL)
SELECT e.label, e.vec_id, coalesce(d, -1)::INT AS cluster FROM e LEFT JOIN (SELECT label, x, dense_rank() OVER (PARTITION BY label ORDER BY least) - 1 AS d FROM c) k ON k.label = e.label AND k.x = e.vec_id""")
def density_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of each label's vectors at distance 1."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return density_clusters(rows, 1.0).select(F.col("id").alias("label"), F.col("pos").alias("vec_id"), "cluster")


@query("SELECT label, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, label))::INT AS rank FROM embeddings GROUP BY label")
def label_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per label, largest first."""
    own = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label")))
