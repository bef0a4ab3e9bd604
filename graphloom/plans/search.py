"""Retrieval and answers: local, global and breadth-first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom import prompts
from graphloom.functions import text as X
from graphloom.operators.graph import bfs, bfs_edges, both_ways, incident_edges
from graphloom.operators.ranking import numbered
from graphloom.operators.similarity import top_k
from graphloom.plans.lineage import materialize
from graphloom.providers import Model, generate, parsed
from graphloom.schemas import ANSWER, INSIGHT

MOST_TOKENS = 30_000


@dataclass
class Graph:
    """The tables that retrieval reads."""

    vertices: DataFrame
    edges: DataFrame
    chunks: DataFrame | None = None
    entity_vectors: DataFrame | None = None
    summaries: DataFrame | None = None
    members: DataFrame | None = None


def hits_of(graph: Graph, probe, k: int = 20, threshold: float | None = 0.2) -> DataFrame:
    """The entities of the nearest vectors, with their rank; a hit that isn't in the graph vanishes after the cut, so fewer may be left."""
    best = top_k(graph.entity_vectors, probe, k, threshold).select("id", "rank", "score")
    return graph.vertices.join(F.broadcast(best), "id")  # k rows


def ranked_relations(hits: DataFrame, graph: Graph) -> DataFrame:
    """All edges at the hits from the hit's side, strongest first; one between two hits is there twice."""
    probes = hits.select(F.col("id").alias("node"), F.col("rank").alias("hit_rank"))
    rows = incident_edges(probes, graph.edges, graph.vertices).join(F.broadcast(probes), "node")
    return numbered(rows, [F.desc("relation_strength"), F.col("hit_rank"), F.col("id")], "position")


def ranked_chunks(hits: DataFrame, graph: Graph) -> DataFrame:
    """The chunks that hits cite, by the first hit that cites each, then by how many of its edges lead to a neighbour that cites it too.

    ``chunk_id, order, relation_counts, content``; a chunk that isn't stored
    is left out.
    """
    cited = hits.select(F.col("id").alias("node"), "rank", F.explode("source_chunk_id").alias("chunk_id")).distinct()
    first = W.partitionBy("chunk_id").orderBy("rank")
    own = cited.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    near = both_ways(graph.edges).join(F.broadcast(hits.select(F.col("id").alias("node"))), "node").select("node", "other")
    theirs = near.join(graph.vertices.select(F.col("id").alias("other"), F.explode(F.array_distinct("source_chunk_id")).alias("chunk_id")), "other")
    counts = theirs.groupBy("node", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    out = own.join(counts, ["node", "chunk_id"], "left").withColumn("relation_counts", F.coalesce("n", F.lit(0).cast("long")))
    out = out.join(graph.chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    return out.select("chunk_id", F.col("rank").alias("order"), "relation_counts", "content")


def related_summaries(hits: DataFrame, graph: Graph, most_level: int = 2) -> DataFrame:
    """Reports of the communities that hits are in, up to a level: ``id, level, n_hits, summary``, those of most hits first."""
    from graphloom.schemas import community_id

    own = hits.select("id").join(graph.members.where(F.col("level") <= most_level), "id").groupBy("level", "cluster_id").agg(F.count(F.lit(1)).alias("n_hits"))
    own = own.withColumn("id", community_id(F.col("level"), F.col("cluster_id")))
    return own.join(graph.summaries, "id").select("id", "level", "n_hits", "summary").orderBy(F.desc("n_hits"), "level", "id")


def _lines(rows: DataFrame, line, order: list) -> DataFrame:
    """One row ``text``: a line for each row, in order. Rows are a retrieved neighbourhood or reports."""
    pairs = rows.select(F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), line.alias("v")).alias("p"))
    return pairs.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]), "\n").alias("text"))


def _or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def local_context(hits: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row ``context``: entities, relations and texts, a section each."""
    a = _lines(hits, F.concat_ws(", ", _or_empty("entity_name"), _or_empty("entity_type"), _or_empty("description")), [F.col("rank")])
    b = _lines(relations, F.concat_ws(", ", _or_empty("subject_label"), _or_empty("object_label"), _or_empty("description"), _or_empty("relation_strength")), [F.col("position")])
    c = _lines(chunks, _or_empty("content"), [F.col("order"), -F.col("relation_counts"), F.col("chunk_id")])
    one = [x.withColumnRenamed("text", n) for x, n in ((a, "entities"), (b, "relations"), (c, "texts"))]
    whole = one[0].join(one[1]).join(one[2])  # one row each
    return whole.select(F.concat(F.lit("Entities\n"), "entities", F.lit("\n\nRelations\n"), "relations", F.lit("\n\nTexts\n"), "texts").alias("context"))


class LocalSearch:
    """Answers from the neighbourhood of the nearest entities."""

    def __init__(self, graph: Graph, embedder, model: Model | None = None, most_tokens: int = MOST_TOKENS, language: str = "english"):
        self.graph, self.embedder, self.model, self.most_tokens, self.language = graph, embedder, model, most_tokens, language

    def search(self, query: str, k: int = 20) -> dict[str, DataFrame]:
        probe = [float(x) for x in self.embedder([query])[0]]
        hits = materialize(hits_of(self.graph, probe, k))
        out = {"entities": hits.orderBy("rank"), "relations": ranked_relations(hits, self.graph), "chunks": ranked_chunks(hits, self.graph)}
        if self.graph.summaries is not None and self.graph.members is not None:
            out["summaries"] = related_summaries(hits, self.graph)
        return out

    def query(self, query: str, k: int = 20) -> DataFrame:
        """One row: ``context, response``."""
        found = self.search(query, k)
        context = local_context(found["entities"], found["relations"], found["chunks"])
        context = context.withColumn("context", X.first_tokens(F.col("context"), self.most_tokens))
        asked = context.withColumn("prompt", prompts.render("local_search", F.lit(query), F.col("context"), self.language))
        got = parsed(generate(asked, "prompt", "answer", self.model), "answer", ANSWER, "parsed")
        return got.select("context", F.coalesce("parsed.response", "answer").alias("response"))


def ranked_insights(insights: DataFrame) -> DataFrame:
    """Insights (``pos, response, rating``) whose rating, cut to a whole number, is above 0, the highest first; ``rank`` from 1."""
    whole = F.coalesce(F.col("rating"), F.lit(0.0)).cast("int")
    rows = insights.withColumn("whole", whole).where("whole > 0")
    return numbered(rows, [F.desc("whole"), F.col("pos")], "rank").drop("whole")


def insight_context(ranked: DataFrame) -> DataFrame:
    """One row ``text``: the numbered insights."""
    return _lines(ranked, F.concat(F.col("rank").cast("string"), F.lit(". Insight: "), _or_empty("response"), F.lit(", rating: "), F.col("rating").cast("string")), [F.col("rank")])


class GlobalSearch:
    """Answers from all community reports: rate each, keep and rank the useful, answer from them."""

    def __init__(self, graph: Graph, model: Model, most_tokens: int = MOST_TOKENS, language: str = "english"):
        self.graph, self.model, self.most_tokens, self.language = graph, model, most_tokens, language

    def search(self, query: str) -> DataFrame:
        rows = self.graph.summaries.select("id", prompts.render("global_search_context", F.lit(query), F.col("summary"), self.language).alias("prompt"))
        got = materialize(parsed(generate(rows, "prompt", "answer", self.model).drop("prompt"), "answer", INSIGHT, "insight"))
        valid = got.where("insight is not null and (insight.rating is null or insight.rating between 0 and 10)")
        return ranked_insights(valid.select(F.col("id").alias("pos"), "insight.*"))

    def query(self, query: str) -> DataFrame:
        """One row: ``context, response``."""
        # each insight has a token at least, so no more than so many can be in the context
        context = insight_context(self.search(query).where(F.col("rank") <= self.most_tokens)).select(X.first_tokens(F.col("text"), self.most_tokens).alias("context"))
        asked = context.withColumn("prompt", prompts.render("global_search", F.lit(query), F.col("context"), self.language))
        got = parsed(generate(asked, "prompt", "answer", self.model), "answer", ANSWER, "parsed")
        return got.select("context", F.coalesce("parsed.response", "answer").alias("response"))


class BreadthFirstSearch:
    """Answers from what lies within some edges of the entities that a query names."""

    def __init__(self, graph: Graph, model: Model | None = None, language: str = "english"):
        self.graph, self.model, self.language = graph, model, language

    def seeds(self, query: str) -> DataFrame:
        """``id`` of the entities whose names are phrases of the query."""
        return self.graph.vertices.where(X.named_by(F.col("entity_name"), F.lit(query))).select("id").distinct()

    def search(self, query: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        nodes = bfs(self.seeds(query), self.graph.edges, depth)
        return nodes.join(self.graph.vertices, "id"), bfs_edges(nodes, self.graph.edges)

    def query(self, query: str, depth: int = 2) -> DataFrame:
        """One row: ``context, response``."""
        nodes, edges = self.search(query, depth)
        a = _lines(nodes, F.concat_ws(", ", _or_empty("entity_name"), _or_empty("entity_type"), _or_empty("description")), [F.col("distance"), F.col("id")])
        b = _lines(edges, F.concat_ws(" -> ", "src", "dst"), [F.col("src"), F.col("dst")]).withColumnRenamed("text", "links")
        context = a.join(b).select(F.concat("text", F.lit("\n\n"), "links").alias("context"))
        asked = context.withColumn("prompt", prompts.render("local_search", F.lit(query), F.col("context"), self.language))
        got = generate(asked, "prompt", "answer", self.model)
        return got.select("context", F.col("answer").alias("response"))
