"""Entities and relations from chunks, by a structured model or by stages of a small one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom import prompts
from graphloom.functions import text as X
from graphloom.plans.lineage import materialize
from graphloom.providers import Model, generate, parsed
from graphloom.schemas import EXTRACTION, UNKNOWN_TYPE, entity_id, relation_id


def entities_of(rows: DataFrame) -> DataFrame:
    """Entities of parsed chunks (``id, doc_id, artifacts``) with their place in the chunk; blank names are dropped."""
    each = rows.select("id", "doc_id", F.posexplode("artifacts.entities").alias("pos", "e"))
    each = each.select(F.col("e.entity_name").alias("entity_name"), F.col("e.entity_type").alias("entity_type"), F.col("e.description").alias("description"), F.col("id").alias("chunk_id"), "doc_id", "pos")
    return each.where("entity_name <> ''").withColumn("id", entity_id(F.col("entity_name"), F.col("entity_type")))


def resolve_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with the ids of the entities that their names mean in their chunk.

    A name means the first entity of the chunk that has it, whatever its
    type (of those at the same place, the one of the least id); a relation
    with an empty or unknown name is dropped. A missing strength is 1.
    """
    first = W.partitionBy("chunk_id", "entity_name").orderBy("pos", "id")
    known = entities.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    out = relations.where("subject_name <> '' and object_name <> ''")
    for side in ("subject", "object"):
        own = known.select("chunk_id", F.col("entity_name").alias(f"{side}_name"), F.col("id").alias(f"{side}_id"))
        out = out.join(own, ["chunk_id", f"{side}_name"])
    strength = F.coalesce(F.col("relation_strength").cast("double"), F.lit(1.0))
    return out.withColumn("relation_strength", strength).withColumn("id", relation_id(F.col("subject_id"), F.col("object_id")))


def relations_of(rows: DataFrame) -> DataFrame:
    """Relations of parsed chunks; those whose strength is outside 0 to 5 are dropped."""
    each = rows.select(F.col("id").alias("chunk_id"), F.posexplode("artifacts.relations").alias("pos", "r"))
    each = each.select("chunk_id", "pos", F.col("r.source_entity").alias("subject_name"), F.col("r.target_entity").alias("object_name"), F.col("r.description").alias("description"), F.col("r.relationship_strength").alias("relation_strength"))
    return each.where("relation_strength is null or relation_strength between 0 and 5")


def dangling(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with an endpoint that their chunk's entities don't have."""
    names = entities.select("chunk_id", F.col("entity_name").alias("n")).distinct()
    for side in ("subject_name", "object_name"):
        found = names.select("chunk_id", F.col("n").alias(side), F.lit(True).alias(f"has_{side}"))
        relations = relations.join(found, ["chunk_id", side], "left")
    return relations.where("has_subject_name is null or has_object_name is null").drop("has_subject_name", "has_object_name")


def extract(chunks: DataFrame, model: Model, validate: bool = False, language: str = "russian", entity_types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations by one structured call per chunk, and a second one to correct it if wanted."""
    kept = ["id", "doc_id", "content"] if validate else ["id", "doc_id"]  # the prompt holds the content, too
    asked = chunks.select(*kept, prompts.render("artifact_extraction", F.col("content"), language, entity_types).alias("prompt"))
    got = materialize(parsed(generate(asked, "prompt", "answer", model).drop("prompt"), "answer", EXTRACTION, "artifacts"))
    if validate:
        again = got.withColumn("prompt", prompts.render("artifact_validation", F.col("answer"), F.col("content"), language)).drop("answer")
        checked = parsed(generate(again.withColumnRenamed("artifacts", "draft"), "prompt", "answer", model), "answer", EXTRACTION, "artifacts")
        got = materialize(checked.withColumn("artifacts", F.coalesce("artifacts", "draft")))
    got = got.where("artifacts is not null")
    entities = entities_of(got)
    return entities, resolve_endpoints(entities, relations_of(got))


def ordered_pairs(entities: DataFrame) -> DataFrame:
    """All n (n - 1) ordered pairs of a chunk's entities by place; chunks with one entity have none."""
    a = entities.select("chunk_id", *[F.col(c).alias(f"subject_{c}") for c in ("id", "name", "pos")])
    b = entities.select("chunk_id", *[F.col(c).alias(f"object_{c}") for c in ("id", "name", "pos")])
    return a.join(b, "chunk_id").where("subject_pos <> object_pos")


def extract_staged(chunks: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Entities and relations by four calls of a small model: list, normalise, describe, relate.

    Each stage's answers are written before the next one, so that nothing is
    asked twice.
    """
    listed = materialize(generate(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "content").withColumn("prompt", prompts.render("list_mentions", F.col("content"))), "prompt", "answer", model))
    each = listed.select("chunk_id", "doc_id", "content", F.posexplode(X.lines(F.col("answer"))).alias("pos", "mention"))
    normal = materialize(generate(each.withColumn("prompt", prompts.render("normalise", F.col("mention"), F.col("content"))), "prompt", "name", model))
    normal = normal.withColumn("name", X.strip(F.coalesce("name", F.lit("")))).where("name <> ''").drop("prompt")
    told = materialize(generate(normal.withColumn("prompt", prompts.render("describe", F.col("name"), F.col("content"))), "prompt", "description", model))
    told = told.withColumn("description", F.coalesce(X.strip(F.col("description")), F.lit(""))).withColumn("entity_type", F.lit(UNKNOWN_TYPE))
    told = told.withColumn("id", entity_id(F.col("name"), F.col("entity_type")))
    pairs = ordered_pairs(told).join(told.select("chunk_id", "content").distinct(), "chunk_id")
    asked = pairs.withColumn("prompt", prompts.render("relate", F.col("subject_name"), F.col("object_name"), F.col("content")))
    said = materialize(generate(asked, "prompt", "answer", model)).withColumn("description", X.relation_text(F.col("answer"))).where("description is not null")
    relations = said.select("chunk_id", "subject_id", "object_id", "subject_name", "object_name", "description", F.lit(1.0).alias("relation_strength"), relation_id(F.col("subject_id"), F.col("object_id")).alias("id"))
    entities = told.select("id", F.col("name").alias("entity_name"), "entity_type", "description", "chunk_id", "doc_id", "pos")
    return entities, relations
