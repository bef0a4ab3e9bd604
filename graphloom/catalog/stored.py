"""Queries on stored graphs: building, changing, searching and exchanging them."""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.catalog import fixtures as X
from graphloom.catalog.registry import query, table
from graphloom.operators import chunking, extraction
from graphloom.operators.graph import components
from graphloom.plans import build, search as S
from graphloom.plans.lineage import checkpoint_folder
from graphloom.plans.records import Records
from graphloom.plans.triplets import refine
from graphloom.providers import RuleModel, truncate
from graphloom.sources.store import GraphStore, read_gml, write_gml
from graphloom.sources.text_files import read_texts


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, name: str) -> GraphStore:
    return GraphStore(spark, _folder(spark, name))


class CountEmbedder:
    """Three numbers of a text that SQL can count too: its length, its letters a, and 1."""

    dim = 3

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])


def _counted(text: str) -> str:
    return f"[length({text})::DOUBLE, (length({text}) - length(replace({text}, 'a', '')))::DOUBLE, 1.0::DOUBLE]"


#: Names of a text in the order of their first place, and each with the next one.
NAMED = """texts AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL),
found AS (SELECT text, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{3,}'), 1) AS nth FROM texts),
firsts AS (SELECT text, name, min(nth) AS nth FROM found GROUP BY ALL),
nexts AS (SELECT text, name, lead(name) OVER (PARTITION BY text ORDER BY nth) AS other FROM firsts)"""


def _built(spark: SparkSession, d: str, **kwargs) -> GraphStore:
    """A graph of the benchmark texts, a chunk each, with the model that goes by capital letters."""
    store = _store(spark, "built")
    docs = table(spark, d, "benchmark").where("text is not null").select("text").distinct()
    whole = lambda docs: docs.select("doc_id", F.lit(0).alias("chunk_order_idx"), F.col("text").alias("content"), F.concat(F.lit("chunk-"), F.md5("text")).alias("id"), F.lit(None).cast("int").alias("num_tokens"))
    build.KnowledgeGraph(build.Builder(RuleModel(), whole, summarise=False, **kwargs), store, reports=False).build(docs)
    return store


@query(f"""WITH {NAMED}, ends AS (SELECT name FROM nexts WHERE other IS NOT NULL UNION SELECT other FROM nexts WHERE other IS NOT NULL)
SELECT name AS entity_name, 'TERM' AS entity_type, count(*)::INT AS n_chunks, md5(string_agg(name || ' is mentioned', '. ')) AS hash FROM firsts WHERE name IN (SELECT name FROM ends) GROUP BY name""")
def built_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a graph built from texts; lone ones are removed."""
    rows = _built(spark, d).load("entities")
    return rows.select("entity_name", "entity_type", F.size("source_chunk_id").alias("n_chunks"), F.md5("description").alias("hash"))


@query(f"""WITH {NAMED} SELECT name AS subject_name, other AS object_name, count(*)::INT AS n_chunks, 1.0::DOUBLE AS relation_strength FROM nexts WHERE other IS NOT NULL GROUP BY ALL""")
def built_relations(spark: SparkSession, d: str) -> DataFrame:
    """Its relations."""
    return _built(spark, d).load("relations").select("subject_name", "object_name", F.size("source_chunk_id").alias("n_chunks"), "relation_strength")


@query(f"""WITH {NAMED}, own AS (SELECT name, other FROM nexts WHERE other IS NOT NULL), ends AS (SELECT name FROM own UNION SELECT other FROM own),
said AS (SELECT f.name, string_agg(f.name || ' is mentioned', '. ') AS said FROM firsts f WHERE f.name IN (SELECT name FROM ends) GROUP BY f.name)
SELECT name AS entity_name, length(name || ' - ' || said)::INT AS n_chars FROM said""")
def built_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first number of the vectors of its entities' texts."""
    store = _built(spark, d, embedder=CountEmbedder())
    return store.load("entities").select("id", "entity_name").join(store.load("entity_vectors"), "id").select("entity_name", F.element_at("vector", 1).cast("int").alias("n_chars"))


class StagedModel:
    """A small model of stages: lists capitalised words, keeps them, says that they are there, and relates those of equal first letters."""

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            text = p.rpartition("TEXT:")[2]
            names = list(dict.fromkeys(re.findall(r"[A-Z][a-z]{3,}", text)))
            if p.startswith("List"):
                out.append("\n".join(names))
            elif p.startswith("Give"):
                out.append(p.split("ENTITY: ")[1].split("\nTEXT:")[0])
            elif p.startswith("Describe"):
                out.append(" seen ")
            else:
                a, b = (re.search(rf"{k}: (\w+)", p)[1] for k in ("FIRST", "SECOND"))
                out.append(f"- {a} like {b}" if a[0] == b[0] else "Нет связи")
        return out


@query(f"""WITH {NAMED} SELECT 'chunk-' || md5(a.text) AS chunk_id, a.name AS subject_name, b.name AS object_name, a.name || ' like ' || b.name AS description
FROM firsts a JOIN firsts b ON a.text = b.text AND a.nth <> b.nth WHERE a.name[1] = b.name[1]""")
def staged_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations by the four stages of a small model."""
    texts = table(spark, d, "benchmark").where("text is not null").select("text").distinct()
    chunks = texts.select(F.concat(F.lit("chunk-"), F.md5("text")).alias("id"), F.md5("text").alias("doc_id"), F.col("text").alias("content"))
    return extraction.extract_staged(chunks, StagedModel())[1].select("chunk_id", "subject_name", "object_name", "description")


class TripletModel:
    """Says of a text that its first word is as its last, and keeps the triple that it is given to pick."""

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            if p.startswith("List the facts"):
                n, part = p.rpartition("TEXT:")[2].split("|")
                out.append(json.dumps([{"subject": n, "relation": "bought", "object": part}, {"subject": part, "relation": "bought", "object": n}]))
            else:
                own = json.loads(p.split("TRIPLE: ")[1].split("\nTEXT:")[0])
                out.append(json.dumps([own]))
        return out


@query("""SELECT n_name AS doc_id, 0 AS pos, n_name AS subject, r_name AS object, true AS validity FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 1, r_name, n_name, false FROM nation JOIN region ON n_regionkey = r_regionkey""")
def triplet_refine(spark: SparkSession, d: str) -> DataFrame:
    """Facts of texts on nations and regions, written with known names and checked against known types."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = nation.select(F.col("n_name").alias("name"), F.lit("NATION").alias("entity_type")).unionByName(nation.select("r_name", F.lit("REGION")).toDF("name", "entity_type").distinct())
    number = {r["name"]: i for i, r in enumerate(names.select("name").distinct().orderBy("name").collect())}  # 25 and 5 names

    class Own:
        dim = len(number) + 1

        def __call__(self, texts: list[str]) -> np.ndarray:
            return np.array([[float(i == number.get(t, len(number))) for i in range(self.dim)] for t in texts])

    vertices = names.select(F.col("name").alias("id"), F.col("name").alias("entity_name"), "entity_type")
    from graphloom.providers import embed

    vectors = embed(vertices.withColumn("content", F.col("entity_name")), "content", "vector", Own())
    edges = nation.select(F.concat_ws("-", "n_name", "r_name").alias("id"), F.col("n_name").alias("subject_id"), F.col("r_name").alias("object_id"), F.lit("bought").alias("description"))
    texts = nation.select(F.col("n_name").alias("doc_id"), F.concat_ws("|", "n_name", "r_name").alias("text"))
    links = embed(edges.select("id", F.col("description").alias("content")), "content", "vector", Own())
    return refine(texts, vectors, links, vertices, edges, TripletModel(), Own()).select("doc_id", "pos", "subject", "object", "validity")


class RatingModel:
    """Rates a text by its length, from 0 to 12.5, so that some ratings are invalid."""

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return [json.dumps({"reasoning": "", "response": "r", "rating": (len(p.rpartition("TEXT:")[2]) % 26) / 2}) for p in prompts]


@query("""WITH r AS (SELECT doc_id, (length(text) % 26) / 2.0 AS rating FROM documents WHERE NOT contains(text, 'TEXT:'))
SELECT doc_id::VARCHAR AS pos, rating::DOUBLE AS rating, (row_number() OVER (ORDER BY trunc(rating)::INT DESC, doc_id::VARCHAR))::INT AS rank FROM r WHERE rating <= 10 AND trunc(rating)::INT > 0""")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Insights from all documents as reports, by a model call each; ratings outside 0 to 10 are dropped."""
    docs = table(spark, d, "documents").where("text is not null and not contains(text, 'TEXT:')")
    g = S.Graph(docs, docs, summaries=docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("summary")))
    return S.GlobalSearch(g, RatingModel()).search("what?").select("pos", "rating", "rank")


@query(f"""WITH {X.GRAPH}, seeds AS (SELECT id FROM vertices WHERE entity_name IN ('ASIA', 'MIDDLE EAST', 'EAST', 'MIDDLE', 'FRANCE')),
near AS (SELECT object_id AS id FROM edges WHERE subject_id IN (SELECT id FROM seeds) UNION SELECT subject_id FROM edges WHERE object_id IN (SELECT id FROM seeds) UNION SELECT id FROM seeds)
SELECT id, entity_name, entity_type FROM vertices WHERE id IN (SELECT id FROM near)""")
def bfs_search(spark: SparkSession, d: str) -> DataFrame:
    """What lies within an edge of the entities that a long question names."""
    asked = "Which of the many customers, suppliers and parts that we know are near ASIA, or else the MIDDLE EAST, but not quite as far as FRANCE?"
    return S.BreadthFirstSearch(S.Graph(X.vertices(spark, d), X.edges(spark, d))).search(asked, 1)[0].select("id", "entity_name", "entity_type")


@query(f"WITH {X.GRAPH} SELECT 'node' AS kind, id, entity_name AS a, entity_type AS b, description, NULL::DOUBLE AS w FROM vertices UNION ALL SELECT 'edge', id, subject_id, object_id, description, relation_strength FROM edges")
def gml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as GML and read again."""
    path = _folder(spark, "gml")
    write_gml(X.vertices(spark, d), X.edges(spark, d), path)
    v, e = read_gml(spark, path)
    nodes = v.select(F.lit("node").alias("kind"), "id", F.col("entity_name").alias("a"), F.col("entity_type").alias("b"), "description", F.lit(None).cast("double").alias("w"))
    return nodes.unionByName(e.select(F.lit("edge").alias("kind"), "id", F.col("subject_id").alias("a"), F.col("object_id").alias("b"), "description", F.col("relation_strength").alias("w")))


@query("SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a text file each, below a line of their id, and read again; a folder for each writing task, which is moved as a whole."""
    path = _folder(spark, "texts")
    docs = table(spark, d, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = docs.select(F.spark_partition_id().alias("part"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    raw = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}  # on a local disk, no second file of checksums for each
    rows.write.partitionBy("part").options(maxRecordsPerFile=1, lineSep="\x1d", **raw).text(path)
    got = read_texts(spark, path).withColumn("at", F.instr("text", "\n"))
    own = F.substring("text", F.col("at") + 1, F.length("text") - F.col("at") - 1)  # without the id's line and the separator at the end
    return got.select(F.expr("try_cast(substring(text, 1, at - 1) as bigint)").alias("doc_id"), F.md5(own).alias("hash"))


def _changed(spark: SparkSession, d: str) -> Records:
    """Entities of the vector graph: all added, the odd ones again, every seventh updated, every fifth deleted."""
    entities, links, _ = X.vector_graph(spark, d)
    own = Records(_store(spark, "records"), CountEmbedder())
    entities = entities.drop("vector").withColumn("documents_id", F.array("id"))
    own.add_entities(entities.withColumn("clusters", F.array().cast("array<struct<level:int,cluster_id:int>>")))
    own.add_relations(links.withColumns({"subject_name": F.col("subject_id"), "object_name": F.col("object_id"), "source_chunk_id": F.array("id")}))
    own.add_entities(entities.where("vec_id % 2 = 1").withColumns({"description": F.lit("!"), "clusters": F.array().cast("array<struct<level:int,cluster_id:int>>")}))
    own.update_entities(own.store.load("entities").where("cast(substring(id, 2) as long) % 7 = 0").withColumn("description", F.lit("new")))
    own.delete_entities(entities.where("vec_id % 5 = 0").select("id"))
    return own


CHANGED = f"""{X.VECTOR_GRAPH}, said AS (SELECT id, vec_id, CASE WHEN vec_id % 7 = 0 THEN 'new' WHEN vec_id % 2 = 1 THEN description || '!' ELSE description END AS description FROM entities WHERE vec_id % 5 <> 0)"""


@query(f"WITH {CHANGED} SELECT id, description FROM said")
def record_changes(spark: SparkSession, d: str) -> DataFrame:
    """Records after additions, merges, updates and deletions."""
    return _changed(spark, d).store.load("entities").select("id", "description")


@query(f"WITH {CHANGED} SELECT 'rel-' || md5(subject_id || ' -> ' || object_id) AS id FROM links l WHERE subject_id IN (SELECT id FROM said) AND object_id IN (SELECT id FROM said)")
def record_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Relation vectors that are left: those of relations whose ends are."""
    return _changed(spark, d).store.load("relation_vectors").select("id")


@query(f"""WITH {CHANGED}, v AS (SELECT id, {_counted("('entity ' || vec_id || ' - ' || description)")} AS v FROM said), q AS (SELECT {_counted("'banana and apple'")} AS q)
SELECT id, round(s, 5) AS score, (row_number() OVER (ORDER BY s DESC, id))::INT AS rank FROM (SELECT id, round(list_cosine_similarity(v, q), 12) AS s FROM v, q) QUALIFY rank <= 20""")
def text_query(spark: SparkSession, d: str) -> DataFrame:
    """The stored vectors nearest to a text, after those changes."""
    from graphloom.plans.records import query_vectors

    own = _changed(spark, d)
    hits = query_vectors(own.store.load("entity_vectors"), "banana and apple", CountEmbedder(), 10**6, -2.0)
    return hits.select("id", F.round("score", 12).alias("s")).orderBy(F.desc("s"), "id").limit(20).withColumn("rank", F.row_number().over(S.W.orderBy(F.desc("s"), "id"))).select("id", F.round("s", 5).alias("score"), "rank")


class ByteTokens:
    """A token for each UTF-8 byte."""

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def decode(self, ids: list[int]) -> str:
        return bytes(ids).decode("utf-8", "ignore")


@query("SELECT doc_id, md5(coalesce(decode(encode(text)[1:40]), '')) AS hash FROM documents WHERE text IS NULL OR octet_length(encode(text)) = length(text)")
def tokenizer_truncate(spark: SparkSession, d: str) -> DataFrame:
    """ASCII texts cut to 40 tokens of a tokenizer."""
    rows = table(spark, d, "documents").where("text is null or octet_length(text) = length(text)")
    return truncate(rows.select("doc_id", "text"), "text", 40, ByteTokens()).select("doc_id", F.md5("text").alias("hash"))


@query()
def rerank_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks split where a scorer of neighbouring sentences (shared words) is lowest."""
    score = lambda a, b: float(len(set(a.lower().split()) & set(b.lower().split())))
    return chunking.scored_chunks(table(spark, d, "documents").select("doc_id", "text"), 400, score)


#: Events in a row, broken before every 97th; those that are 5 modulo 1,000 also hang on one hub.
CHAINS = """WITH e AS (SELECT event_id, event_id // 97 AS chain, event_id % 1000 = 5 AS hub FROM events),
c AS (SELECT chain, min(event_id) AS least, bool_or(hub) AS hub FROM e GROUP BY chain), h AS (SELECT min(least) AS least FROM c WHERE hub)
SELECT event_id AS id, CASE WHEN c.hub THEN least(h.least, -1) ELSE c.least END AS component FROM e JOIN c USING (chain), h UNION ALL SELECT -1, -1"""


@query(CHAINS)
def chain_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of all events, in long chains, some of which hang on a hub."""
    events = table(spark, d, "events").select(F.col("event_id").alias("id"))
    hub = spark.range(1).select(F.lit(-1).cast("long").alias("id"))
    nexts = events.join(events.select((F.col("id") - 1).alias("id"), F.lit(True).alias("there")), "id").where("(id + 1) % 97 <> 0")
    links = nexts.select(F.col("id").alias("subject_id"), (F.col("id") + 1).alias("object_id"))
    links = links.unionByName(events.where("id % 1000 = 5").select(F.lit(-1).cast("long").alias("subject_id"), F.col("id").alias("object_id")))
    return components(events.unionByName(hub), links)
