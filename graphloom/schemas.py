"""Record schemas of the knowledge graph, and the ids of its records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEMBERSHIP = record(level=I, cluster_id=I)
CHUNK = record(id=S, content=S, chunk_order_idx=I, doc_id=S, num_tokens=I)
ENTITY = record(id=S, entity_name=S, entity_type=S, description=S, source_chunk_id=T.ArrayType(S), documents_id=T.ArrayType(S), clusters=T.ArrayType(MEMBERSHIP))
RELATION = record(id=S, subject_id=S, object_id=S, subject_name=S, object_name=S, description=S, relation_strength=D, source_chunk_id=T.ArrayType(S))
COMMUNITY = record(id=S, level=I, cluster_id=I, entity_ids=T.ArrayType(S), relation_ids=T.ArrayType(S))
SUMMARY = record(id=S, summary=S)
VECTOR = record(id=S, content=S, vector=T.ArrayType(T.FloatType()))

#: What model calls return.
EXTRACTION = record(
    entities=T.ArrayType(record(entity_name=S, entity_type=S, description=S)),
    relations=T.ArrayType(record(source_entity=S, target_entity=S, description=S, relationship_strength=I)),
)
REPORT = record(title=S, summary=S, rating=D, rating_explanation=S, findings=T.ArrayType(record(summary=S, explanation=S)))
INSIGHT = record(reasoning=S, response=S, rating=D)
ANSWER = record(response=S)
TRIPLETS = T.ArrayType(record(subject=S, relation=S, object=S))

#: Entity types that extraction asks for unless told otherwise (fixed values).
ENTITY_TYPES = (
    "AGE", "FAMILY", "AWARD", "IDEOLOGY", "PERCENT", "CITY", "LANGUAGE", "PERSON", "COUNTRY", "LAW",
    "PRODUCT", "CRIME", "PENALTY", "PROFESSION", "DATE", "MONEY", "RELIGION", "DISEASE", "NATIONALITY", "STATE_OR_PROV",
    "ORDINAL", "TIME", "EVENT", "DISTRICT", "WORK_OF_ART", "ORGANIZATION", "FACILITY", "NUMBER", "LOCATION",
)
UNKNOWN_TYPE = "UNKNOWN"


def hash_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and the MD5 of the parts' text."""
    return F.concat(F.lit(prefix), F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])))


def chunk_id(content: Column) -> Column:
    return hash_id("chunk-", content)


def entity_id(name: Column, kind: Column) -> Column:
    return hash_id("ent-", name, " - ", kind)


def relation_id(subject: Column, obj: Column) -> Column:
    return hash_id("rel-", subject, " -> ", obj)


def community_id(level: Column, cluster: Column) -> Column:
    return hash_id("com-", level.cast("string"), " - ", cluster.cast("string"))
