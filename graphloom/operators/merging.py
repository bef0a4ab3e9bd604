"""Grouping and upserting entities and relations.

Lists that depend on order are built from (position, value) pairs and sorted,
as the order of ``collect_list`` after a shuffle is undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom import prompts
from graphloom.plans.lineage import materialize
from graphloom.providers import Model, generate
from graphloom.schemas import entity_id, relation_id


def _ordered(value: str, pos: str = "pos") -> Column:
    """Non-null values in order of position."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def _union(name: str) -> Column:
    """The distinct elements of all arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(name)))))


def group_entities(entities: DataFrame) -> DataFrame:
    """One row per (entity_name, entity_type): descriptions in order, how many there are, and where they come from.

    ``entities`` needs ``pos``. Null names or types are dropped.
    """
    rows = entities.where("entity_name is not null and entity_type is not null")
    out = rows.groupBy("entity_name", "entity_type").agg(
        _ordered("description").alias("descriptions"), F.count("description").alias("duplicate_count"), _union("source_chunk_id").alias("source_chunk_id"), _union("documents_id").alias("documents_id")
    )
    no_clusters = F.array().cast("array<struct<level:int,cluster_id:int>>")
    return out.withColumn("id", entity_id(F.col("entity_name"), F.col("entity_type"))).withColumn("clusters", no_clusters).withColumn("description", F.array_join("descriptions", ". "))


def group_relations(relations: DataFrame) -> DataFrame:
    """One row per directed (subject_id, object_id): the first names, descriptions by line, mean strength, sources."""
    rows = relations.where("subject_id is not null and object_id is not null")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("subject_name", "object_name")]
    out = rows.groupBy("subject_id", "object_id").agg(
        *first, F.array_join(_ordered("description"), "\n").alias("description"), F.avg("relation_strength").alias("relation_strength"), _union("source_chunk_id").alias("source_chunk_id"), F.count("description").alias("duplicate_count")
    )
    return out.withColumn("id", relation_id(F.col("subject_id"), F.col("object_id")))


def summarised(grouped: DataFrame, prompt: Column, model: Model | None, strict: bool = False) -> DataFrame:
    """Grouped rows whose several descriptions a model has made one; what the model fails on keeps its text.

    Without a model they keep their joined text, or are dropped if ``strict``.
    Only rows with several descriptions are asked about.
    """
    if model is None:
        return grouped.where("duplicate_count <= 1") if strict else grouped
    asked = grouped.withColumn("prompt", F.when(F.col("duplicate_count") > 1, prompt))
    got = generate(asked, "prompt", "answer", model)
    return got.withColumn("description", F.coalesce("answer", "description")).drop("prompt", "answer")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Whole records by key, new ones over old ones; of new ones with one key, the last by ``order``, and of equal ones always the same."""
    rank = F.col(order) if order else F.lit(0)
    rows = old.withColumn("_r", F.struct(F.lit(0).alias("new"), F.lit(None).cast("long").alias("at")))
    rows = rows.unionByName(new.withColumn("_r", F.struct(F.lit(1).alias("new"), rank.cast("long").alias("at"))), allowMissingColumns=True)
    names = [c for c in rows.columns if c != "_r"]
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_r"), F.xxhash64(*[F.col(f"`{c}`") for c in names])))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n", "_r")


def running_mean(relations: DataFrame, separator: str = "") -> DataFrame:
    """Relations of one pair merged in order, as repeated upserts would: each strength is averaged with what was there.

    The k-th of n strengths weighs 2^-(n-1) if it is the first, else
    2^-(n-k+1); descriptions are joined in order, sources united.
    """
    own = W.partitionBy("subject_id", "object_id")
    k, n = F.row_number().over(own.orderBy("pos")), F.count(F.lit(1)).over(own)
    weight = F.pow(F.lit(2.0), -F.when(k == 1, n - 1).otherwise(n - k + 1))
    rows = relations.withColumn("share", weight * F.col("relation_strength"))
    return rows.groupBy("subject_id", "object_id").agg(
        F.sum("share").alias("relation_strength"), F.array_join(_ordered("description"), separator).alias("description"), _union("source_chunk_id").alias("source_chunk_id"), F.max_by("subject_name", "pos").alias("subject_name"), F.max_by("object_name", "pos").alias("object_name")
    ).withColumn("id", relation_id(F.col("subject_id"), F.col("object_id")))


def merge_entities(old: DataFrame, new: DataFrame, separator: str = "") -> DataFrame:
    """Entities by id: descriptions joined, old ones first; sources, documents and clusters united."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    rows = rows.withColumn("pos", F.struct("age", "pos"))
    return rows.groupBy("id").agg(
        F.min_by("entity_name", "pos").alias("entity_name"), F.min_by("entity_type", "pos").alias("entity_type"), F.array_join(_ordered("description"), separator).alias("description"),
        _union("source_chunk_id").alias("source_chunk_id"), _union("documents_id").alias("documents_id"), F.array_distinct(F.flatten(_ordered("clusters"))).alias("clusters"),
    )


def describe_clusters(grouped: DataFrame, embedder, model: Model, more_than: int = 128, eps: float = 0.5) -> DataFrame:
    """Entities with very many descriptions get a description per cluster of them, joined by ``". "``.

    Clusters are those of density with two neighbours at least, which are the
    components of links within ``eps``; what has no neighbour is one bucket.
    """
    from graphloom.operators.clustering import density_clusters
    from graphloom.providers import embed

    many = grouped.where(F.size("descriptions") > more_than)
    each = many.select("id", F.posexplode("descriptions").alias("pos", "text"))
    vectors = materialize(embed(each, "text", "vector", embedder))
    joined = density_clusters(vectors, eps).groupBy("id", "cluster").agg(F.array_join(_ordered("text"), "\n").alias("text"), F.min("pos").alias("pos"))
    told = materialize(generate(joined.withColumn("prompt", prompts.render("cluster_summarize", F.col("text"))), "prompt", "answer", model))
    text = told.withColumn("said", F.coalesce("answer", "text")).groupBy("id").agg(F.array_join(_ordered("said"), ". ").alias("clustered"))
    return grouped.join(text, "id", "left").withColumn("description", F.coalesce("clustered", "description")).drop("clustered")
