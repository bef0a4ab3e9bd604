"""Triplets of a text, written with known names and checked against known type pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom import prompts
from graphloom.operators.similarity import candidates, top_k_by_probe
from graphloom.plans.lineage import materialize
from graphloom.providers import Embedder, Model, embed, generate, parsed
from graphloom.schemas import TRIPLETS


def allowed_types(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``relation, subject_type, object_type``: the pairs of types between which each relation (by description) is known."""
    kinds = vertices.select("id", "entity_type")
    s = kinds.select(F.col("id").alias("subject_id"), F.col("entity_type").alias("subject_type"))
    o = kinds.select(F.col("id").alias("object_id"), F.col("entity_type").alias("object_type"))
    return edges.join(s, "subject_id").join(o, "object_id").select(F.col("description").alias("relation"), "subject_type", "object_type").distinct()


def validity(triplets: DataFrame, allowed: DataFrame) -> DataFrame:
    """Triplets (with ``relation, subject_type, object_type``) with ``validity``: whether their relation is known between these types."""
    known = allowed.withColumn("known", F.lit(True))
    out = triplets.join(known, ["relation", "subject_type", "object_type"], "left")
    return out.withColumn("validity", F.coalesce("known", F.lit(False))).drop("known")


def refine(texts: DataFrame, entity_vectors: DataFrame, relation_vectors: DataFrame, vertices: DataFrame, edges: DataFrame, model: Model | None, embedder: Embedder, k: int = 5) -> DataFrame:
    """``doc_id, pos, subject, relation, object, validity`` from ``doc_id, text``; blank texts have none.

    A term is embedded and searched once, however often it occurs. A triplet
    that the model doesn't rewrite stays as it is; types are those of the
    best hit of each end.
    """
    spark = texts.sparkSession
    if model is None:
        return spark.createDataFrame([], "doc_id string, pos int, subject string, relation string, object string, validity boolean")
    asked = texts.where("trim(text) <> ''").withColumn("prompt", prompts.render("triplets", F.col("text")))
    raw = materialize(parsed(generate(asked, "prompt", "answer", model), "answer", TRIPLETS, "t").select("doc_id", F.posexplode("t").alias("pos", "t")).select("doc_id", "pos", "t.*"))
    ends = raw.select(F.explode(F.array("subject", "object")).alias("term")).where("term is not null")
    found = _found(ends, entity_vectors, vertices.select("id", F.col("entity_name").alias("name"), F.col("entity_type").alias("kind")), embedder, k)
    links = _found(raw.select(F.col("relation").alias("term")).where("term is not null"), relation_vectors, edges.select("id", F.col("description").alias("name"), F.lit(None).cast("string").alias("kind")), embedder, k)
    names, facts = candidates(ends, found), candidates(raw.select(F.col("relation").alias("term")), links)
    out = raw
    for own, c in ((names, "subject"), (facts, "relation"), (names, "object")):
        out = out.join(own.select(F.col("term").alias(c), F.col("candidates").alias(f"{c}_candidates")), c, "left")
    best = found.where("rank = 1").select("term", "kind")
    for c in ("subject", "object"):
        out = out.join(best.select(F.col("term").alias(c), F.col("kind").alias(f"{c}_type")), c, "left")
    known = F.to_json(F.struct("subject_candidates", "relation_candidates", "object_candidates"))
    own = F.to_json(F.struct("subject", "relation", "object"))
    picked = parsed(generate(out.withColumn("prompt", prompts.render("pick_triplet", own, known)), "prompt", "answer", model), "answer", TRIPLETS, "new")
    new = F.get("new", F.lit(0))
    for c in ("subject", "relation", "object"):
        picked = picked.withColumn(c, F.coalesce(new[c], F.col(c)))
    return validity(picked, allowed_types(edges, vertices)).select("doc_id", "pos", "subject", "relation", "object", "validity")


def _found(terms: DataFrame, vectors: DataFrame, records: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """``term, rank, name, kind`` of the records nearest to each distinct term."""
    own = materialize(embed(terms.distinct(), "term", "probe", embedder).where("probe is not null"))
    best = top_k_by_probe(own.select(F.col("term").alias("probe_id"), "probe"), vectors, k)
    return materialize(best.join(records, "id").select(F.col("probe_id").alias("term"), "rank", "name", "kind"))
