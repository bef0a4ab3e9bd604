"""Adding, reading, changing and deleting records of a stored graph.

Each change is one new snapshot; vectors of deleted records go with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators import merging
from graphloom.operators.graph import incident_edges, neighbours, remove_edges, remove_nodes
from graphloom.operators.keyed import get_by_id, get_by_ids, upsert
from graphloom.operators.similarity import similar_relations, similar_to, top_k
from graphloom.plans.build import entity_texts, relation_texts
from graphloom.plans.lineage import materialize
from graphloom.providers import Embedder, embed
from graphloom.sources.store import GraphStore


def upsert_vectors(old: DataFrame, texts: DataFrame, embedder: Embedder, batch: int = 16) -> DataFrame:
    """Vectors with those of new texts in the place of old ones of the same id."""
    return upsert(old, materialize(embed(texts, "content", "vector", embedder, batch)))


def query_vectors(vectors: DataFrame, text: str, embedder: Embedder, k: int = 5, threshold: float = 0.2) -> DataFrame:
    """The k rows nearest to a text, as far as their cosine is the threshold or more."""
    return top_k(vectors, [float(x) for x in embedder([text])[0]], k, threshold)


class Records:
    """The records of a graph in a store."""

    def __init__(self, store: GraphStore, embedder: Embedder | None = None):
        self.store, self.embedder = store, embedder

    def _save(self, **tables: DataFrame) -> str:
        return self.store.save(**{k: materialize(v) for k, v in tables.items()})

    # entities

    def add_entities(self, entities: DataFrame, separator: str = "") -> str:
        """Merges entities into those of the same id."""
        names = [f.name for f in self.store.load("entities").schema.fields]
        pos = F.struct(F.lit("").alias("a"))
        old, new = (df.select(*names).withColumn("pos", pos) for df in (self.store.load("entities"), entities))
        merged = materialize(merging.merge_entities(old, new, separator))
        return self._save(entities=merged, **self._entity_vectors(merged.join(entities.select("id"), "id", "left_semi")))

    def _entity_vectors(self, changed: DataFrame) -> dict[str, DataFrame]:
        if self.embedder is None:
            return {}
        return {"entity_vectors": upsert_vectors(self.store.load("entity_vectors"), entity_texts(changed), self.embedder)}

    def get_entity(self, own: str) -> DataFrame:
        return get_by_id(self.store.load("entities"), own)

    def get_entities(self, asked: DataFrame) -> DataFrame:
        """The entities of ``pos, id``, in that order; null where there is none."""
        return get_by_ids(self.store.load("entities"), asked).orderBy("pos")

    def update_entities(self, entities: DataFrame) -> str:
        """Entities in the place of those of the same id."""
        return self._save(entities=upsert(self.store.load("entities"), entities), **self._entity_vectors(entities))

    def delete_entities(self, gone: DataFrame) -> str:
        """Removes entities (``id``), their relations and the vectors of both."""
        v, e = remove_nodes(self.store.load("entities"), self.store.load("relations"), gone.select("id"))
        e = materialize(e)
        kept = self.store.load("relation_vectors").join(e.select("id"), "id", "left_semi")
        return self._save(entities=v, relations=e, relation_vectors=kept, entity_vectors=self.store.load("entity_vectors").join(gone.select("id"), "id", "left_anti"))

    # relations

    def add_relations(self, relations: DataFrame, separator: str = "") -> str:
        """Merges relations into those of the same pair, strengths by running mean."""
        names = ("subject_id", "object_id", "subject_name", "object_name", "description", "relation_strength", "source_chunk_id")
        old, new = (df.select(*names, F.struct(F.lit(age).alias("age"), F.col("id")).alias("pos")) for age, df in ((0, self.store.load("relations")), (1, relations)))
        merged = materialize(merging.running_mean(old.unionByName(new), separator))
        return self._save(relations=merged, **self._relation_vectors(merged.join(relations.select("subject_id", "object_id"), ["subject_id", "object_id"], "left_semi")))

    def _relation_vectors(self, changed: DataFrame) -> dict[str, DataFrame]:
        if self.embedder is None:
            return {}
        return {"relation_vectors": upsert_vectors(self.store.load("relation_vectors"), relation_texts(changed), self.embedder)}

    def get_relations(self, s: str, o: str) -> DataFrame:
        """The relations between two entities, in either direction."""
        e = self.store.load("relations")
        return e.where(((F.col("subject_id") == s) & (F.col("object_id") == o)) | ((F.col("subject_id") == o) & (F.col("object_id") == s)))

    def update_relations(self, relations: DataFrame) -> str:
        return self._save(relations=upsert(self.store.load("relations"), relations), **self._relation_vectors(relations))

    def delete_relations(self, gone: DataFrame) -> str:
        """Removes the relations between pairs (``u, v``) and their vectors."""
        e = materialize(remove_edges(self.store.load("relations"), gone))
        return self._save(relations=e, relation_vectors=self.store.load("relation_vectors").join(e.select("id"), "id", "left_semi"))

    def entity_relations(self, own: str) -> DataFrame:
        """The edges at an entity, from its side."""
        probe = self.store.spark.range(1).select(F.lit(own).alias("node"))
        return incident_edges(probe, self.store.load("relations"), self.store.load("entities"))

    def entity_neighbours(self, own: str) -> DataFrame:
        probe = self.store.spark.range(1).select(F.lit(own).alias("node"))
        return neighbours(probe, self.store.load("relations"), self.store.load("entities"))

    # summaries

    def add_summaries(self, summaries: DataFrame) -> str:
        """Reports (``id, summary``) in the place of those of the same id; null ones are left out."""
        return self._save(community_summaries=upsert(self.store.load("community_summaries"), summaries.where("summary is not null")))

    def get_summary(self, own: str) -> DataFrame:
        return get_by_id(self.store.load("community_summaries"), own)

    def delete_summaries(self, gone: DataFrame) -> str:
        return self._save(community_summaries=self.store.load("community_summaries").join(gone.select("id"), "id", "left_anti"))

    # similarity

    def similar_entities(self, own: str, k: int = 5) -> DataFrame:
        """The entities most like a stored one."""
        return similar_to(self.store.load("entity_vectors"), own, self._vector("entity_vectors", own), self.store.load("entities"), k, self._embedded(entity_texts, "entities"))

    def similar_relations(self, own: str, k: int = 5) -> DataFrame:
        return similar_relations(self.store.load("relation_vectors"), own, self._vector("relation_vectors", own), self.store.load("relations"), k, self._embedded(relation_texts, "relations"))

    def entities_like(self, text: str, k: int = 5) -> DataFrame:
        """The entities of the vectors nearest to a text."""
        hits = query_vectors(self.store.load("entity_vectors"), text, self.embedder, k).select("id", "score", "rank")
        return self.store.load("entities").join(hits, "id").orderBy("rank")

    def relations_like(self, text: str, k: int = 5) -> DataFrame:
        probe = [float(x) for x in self.embedder([text])[0]]
        return similar_relations(self.store.load("relation_vectors"), "", probe, self.store.load("relations"), k)

    def _embedded(self, texts, name: str) -> DataFrame | None:
        """Vectors of all records, made for a search that the stored ones give nothing to."""
        return None if self.embedder is None else embed(texts(self.store.load(name)), "content", "vector", self.embedder)

    def _vector(self, name: str, own: str) -> list[float]:
        """The stored vector of a record, else that of its text."""
        row = self.store.load(name).where(F.col("id") == own).select("vector").first()
        if row and row["vector"] is not None:
            return list(row["vector"])
        made = self._embedded(*((entity_texts, "entities") if name == "entity_vectors" else (relation_texts, "relations")))
        row = None if made is None else made.where(F.col("id") == own).first()
        return list(row["vector"]) if row and row["vector"] is not None else []
