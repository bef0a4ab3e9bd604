"""Contracts of the engine's operators on small inputs."""

from __future__ import annotations

import json
import random
import shutil
import threading
import time
from collections import Counter
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import prompts
from graphloom.functions import text as X
from graphloom.operators import chunking, communities, extraction, graph, merging, similarity
from graphloom.operators.clustering import cluster_of
from graphloom.operators.components import connected_components
from graphloom.plans import build, search, triplets
from graphloom.providers import FileTokenizer, HashEmbedder, HttpEmbedder, HttpModel, RateGate, Retrying, RuleModel, TiktokenTokenizer, embed, generate, shared, statistics, truncate
from graphloom.plans.records import Records
from graphloom.settings import Endpoint
from graphloom.sources.store import GraphStore, read_gml, write_gml
from graphloom.sources.text_files import read_texts


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("overlap", "want"),
    [(0, ["aaaa. bb.", "cccc.", "dddddddddddd."]), (2, ["aaaa. bb.", "b. cccc.", "c. dddddddddddd."])],
)
def test_packing_folds_sentences(spark, overlap, want):
    assert one(spark, X.pack(X.sentences(F.lit("aaaa. bb. cccc. dddddddddddd.")), 10, overlap)) == want


def test_text_functions(spark):
    assert one(spark, X.strip(F.lit(" \n a b\t"))) == "a b"
    assert one(spark, X.lines(F.lit("a\n\n  b \r\nc"))) == ["a", "b", "c"]
    assert sorted(one(spark, X.phrases(F.lit("a, b c!")))) == ["a", "a b", "a b c", "a c", "b", "b c", "c"]
    assert one(spark, X.phrases(F.lit(""))) == [""]
    assert len(one(spark, X.phrases(F.lit(" ".join("abcdefghijklmnop"))))) > 100
    assert one(spark, X.first_tokens(F.lit(None).cast("string"), 3)) == ""


def test_denied_relations(spark):
    rows = [("", None), ("-", None), ("—", None), ("Нет связи", None), ("Отсутствует отношение", None), ("В тексте нет связи", "В тексте нет связи"), ("- брат", "брат"), (None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "a string")
    assert [r[0] for r in df.select(X.relation_text(F.col("a"))).collect()] == [w for _, w in rows]


def test_endpoints_mean_the_first_entity_of_a_name(spark):
    e = spark.createDataFrame([("c", "A", "PERSON", 0, "id1"), ("c", "A", "CITY", 1, "id2"), ("c", "B", "CITY", 2, "id3"), ("d", "Z", "CITY", 0, "id4")], "chunk_id string, entity_name string, entity_type string, pos int, id string")
    r = spark.createDataFrame([("c", "A", "B", None), ("c", "A", "Z", 2), ("c", "", "B", 2)], "chunk_id string, subject_name string, object_name string, relation_strength int")
    assert [(x["subject_id"], x["object_id"], x["relation_strength"]) for x in extraction.resolve_endpoints(e, r).collect()] == [("id1", "id3", 1.0)]


def test_running_mean(spark):
    rows = [(i, "a", "b", f"d{i}", s) for i, s in enumerate((1.0, 4.0, 2.0, 5.0))]
    df = spark.createDataFrame(rows, "pos int, subject_id string, object_id string, description string, relation_strength double")
    df = df.withColumns({"subject_name": F.col("subject_id"), "object_name": F.col("object_id"), "source_chunk_id": F.array(F.col("description"))})
    got = merging.running_mean(df).first()
    assert (got["relation_strength"], got["description"], got["source_chunk_id"]) == (3.625, "d0d1d2d3", ["d0", "d1", "d2", "d3"])


def test_duplicates_are_lost_only_strictly(spark):
    df = spark.createDataFrame([(0, "A", "T", "x"), (1, "A", "T", "y"), (2, "B", "T", "z"), (3, None, "T", "n")], "pos int, entity_name string, entity_type string, description string")
    df = df.withColumns({"source_chunk_id": F.array(F.lit("c")), "documents_id": F.array(F.lit("d"))})
    grouped = merging.group_entities(df)
    assert {r["entity_name"]: r["description"] for r in merging.summarised(grouped, F.lit(""), None).collect()} == {"A": "x. y", "B": "z"}
    assert [r["entity_name"] for r in merging.summarised(grouped, F.lit(""), None, strict=True).collect()] == ["B"]
    told = merging.summarised(grouped, prompts.summarise_entity(F.col("entity_name"), F.col("description"), "english"), lambda ps: ["short"] * len(ps))
    assert {r["entity_name"]: r["description"] for r in told.collect()} == {"A": "short", "B": "z"}


def path(spark):
    v = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, entity_name string")
    e = spark.createDataFrame([(f"{s}{o}", s, o) for s, o in ("ab", "bc", "cd")], "id string, subject_id string, object_id string")
    return v, e


def test_breadth_first(spark):
    v, e = path(spark)
    seen = graph.bfs(v.where("id = 'a'").select("id"), e, 1)
    assert sorted(r["id"] for r in seen.collect()) == ["a", "b"]
    assert sorted((r["src"], r["dst"]) for r in graph.bfs_edges(seen, e).collect()) == [("a", "b"), ("b", "c")]


def test_isolated_nodes_and_loops(spark):
    v, _ = path(spark)
    e = spark.createDataFrame([("1", "a", "b"), ("2", "c", "c")], "id string, subject_id string, object_id string")
    assert sorted(r["id"] for r in graph.connected_nodes(v, e).collect()) == ["a", "b", "c"]
    assert {r["id"]: r["degree"] for r in graph.degrees(e).collect()} == {"a": 1, "b": 1, "c": 2}
    assert len(graph.both_ways(e).collect()) == 3


def test_edge_between_two_hits_is_there_twice(spark):
    v, e = path(spark)
    hits = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    own = e.where("id = 'ab'").withColumn("relation_strength", F.lit(1.0))
    rows = search.ranked_relations(hits, search.Graph(v, own)).collect()
    assert sorted((r["node"], r["other"]) for r in rows) == [("a", "b"), ("b", "a")]


def test_hit_outside_the_graph_vanishes_after_the_cut(spark):
    v, e = path(spark)
    vectors = spark.createDataFrame([("z", [1.0, 0.0]), ("a", [0.9, 0.1]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    assert [r["id"] for r in search.hits_of(search.Graph(v, e, entity_vectors=vectors), [1.0, 0.0], 2).collect()] == ["a"]
    assert similarity.top_k(vectors, [0.0, 0.0], 2).count() == 0
    assert similarity.top_k(vectors, [0.0, 0.0], 2, soft=True).count() == 2


def test_insights_are_cut_to_whole_ratings(spark):
    rows = [(0, "a", 0.9), (1, "b", 7.1), (2, "c", 7.9), (3, "d", 3.0), (4, "e", None)]
    got = search.ranked_insights(spark.createDataFrame(rows, "pos int, response string, rating double")).orderBy("rank").collect()
    assert [r["response"] for r in got] == ["b", "c", "d"]
    assert search.insight_context(spark.createDataFrame(rows[1:2], "pos int, response string, rating double").withColumn("rank", F.lit(1))).first()[0] == "1. Insight: b, rating: 7.1"


def test_validity(spark):
    allowed = spark.createDataFrame([("works at", "PERSON", "ORGANIZATION")], "relation string, subject_type string, object_type string")
    asked = spark.createDataFrame([(1, "works at", "PERSON", "ORGANIZATION"), (2, "works at", "PERSON", "CITY")], "n int, relation string, subject_type string, object_type string")
    assert {r["n"]: r["validity"] for r in triplets.validity(asked, allowed).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(i, i + 1) for i in range(60, 100)]
    label = list(range(101))
    for _ in range(101):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.range(101), spark.createDataFrame(pairs, "u long, v long"))
    assert {r["id"]: r["component"] for r in got.collect()} == dict(enumerate(label))


def test_communities(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(6) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    e = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "id string, subject_id string, object_id string")
    v = spark.createDataFrame([(f"{g}{i}",) for g in "xyz" for i in range(6)] + [("lone",)], "id string")
    for most, task_edges in ((10, 10**6), (4, 10**6), (10, 5)):
        rows = communities.communities(v, e, most, task_edges=task_edges).collect()
        first = {r["id"]: r["cluster_id"] for r in rows if r["level"] == 0}
        assert set(first) == {r["id"] for r in v.collect()}
        assert sorted(set(first.values())) == list(range(len(set(first.values()))))
        deepest: dict[str, tuple[int, int]] = {}
        for r in rows:
            deepest[r["id"]] = max(deepest.get(r["id"], (-1, -1)), (r["level"], r["cluster_id"]))
        sizes: dict[tuple[int, int], int] = {}
        for c in deepest.values():
            sizes[c] = sizes.get(c, 0) + 1
        assert max(sizes.values()) <= most
        if task_edges > 100:
            assert all(first[f"{g}{i}"] == first[f"{g}0"] for g in "xyz" for i in range(6))
    number = {x: i for i, x in enumerate(sorted({a for p in pairs for a in p}))}
    adj = {i: {} for i in number.values()}
    for a, b in pairs:
        adj[number[a]][number[b]] = adj[number[b]][number[a]] = 1.0
    assert communities.modularity(adj, communities.cluster(adj)) > 0.55


def test_communities_of_a_large_bipartite_graph(spark):
    rng = random.Random(2)
    pairs = sorted({(f"hub{g if rng.random() < 0.9 else rng.randrange(6)}", f"leaf{g}-{i}") for g in range(6) for i in range(80) for _ in range(2)})
    pairs += [(f"top{g % 2}", f"hub{g}") for g in range(6)] + [("top0", "hub1")]
    e = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "id string, subject_id string, object_id string")
    v = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    number = {r["id"]: i for i, r in enumerate(v.orderBy("id").collect())}
    adj = {i: {} for i in number.values()}
    for a, b in pairs:
        adj[number[a]][number[b]] = adj[number[b]][number[a]] = 1.0
    whole = communities.modularity(adj, communities.cluster(adj))
    for most, task_edges in ((90, 300),):
        rows = communities.communities(v, e, most, task_edges=task_edges).collect()
        first = {number[r["id"]]: r["cluster_id"] for r in rows if r["level"] == 0}
        assert len(first) == len(number) and len(set(first.values())) < len(number) / 10
        assert communities.modularity(adj, first) > 0.9 * whole
        assert len({(r["id"], r["level"]) for r in rows}) == len(rows)
        deepest: dict[str, tuple[int, int]] = {}
        for r in rows:
            deepest[r["id"]] = max(deepest.get(r["id"], (-1, -1)), (r["level"], r["cluster_id"]))
        assert max(Counter(deepest.values()).values()) <= most


def test_density_clusters():
    x = np.array([[0.0], [0.4], [0.8], [5.0], [9.0], [9.1]])
    assert cluster_of(x, 0.5).tolist() == [0, 0, 0, -1, 1, 1]


def test_semantic_split():
    parts = chunking.split_weakest(["a a", "b b", "c c"], np.array([0.9, 0.1]), lambda s: len(s.split()), 4)
    assert parts == ["a a b b", "c c"]


def test_failed_calls_keep_their_rows(spark):
    def model(ps):
        if any("bad" in p for p in ps):
            raise RuntimeError
        return [p.upper() for p in ps]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "n int, p string")
    counts = statistics(generate(df, "p", "a", model, batch=1), "p", "a").first()
    assert (counts["requests"], counts["succeeded"], counts["failed"], counts["words_sent"]) == (2, 1, 1, 2)
    assert {r["n"]: r["a"] for r in generate(df, "p", "a", model, batch=1).collect()} == {1: "GOOD", 2: None, 3: None}
    assert [r["v"] is None for r in embed(df, "p", "v", HashEmbedder(8)).orderBy("n").collect()] == [False, False, True]


def test_retry_and_rate():
    calls, naps = [], []

    def flaky(ps):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return ps

    assert Retrying(flaky, sleep=naps.append)(["x"]) == ["x"] and naps == [4.0, 8.0]
    now = [0.0]
    gate = RateGate(2, None, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)).share(2)
    for _ in range(3):
        gate.wait()
    assert now[0] == pytest.approx(2.0)


class Words:
    def encode(self, text):
        return text.split()

    def decode(self, ids):
        return " ".join(ids)


def test_truncate(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    assert [r["t"] for r in truncate(df, "t", 2, Words()).collect()] == ["a b", ""]


def test_prompts():
    assert set(prompts.CATALOG) >= {"artifact_extraction", "artifact_validation", "community_report", "global_search", "local_search"}
    with pytest.raises(KeyError):
        prompts.get("none")


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_text("привет", encoding="utf-8")
    (tmp_path / "2.md").write_text("x")
    (tmp_path / "3.txt").write_bytes(b"\xff\xfe")
    assert [r["text"] for r in read_texts(spark, str(tmp_path), [".txt"]).collect()] == ["привет"]
    assert read_texts(spark, str(tmp_path)).count() == 2


class Model(RuleModel):
    """Also writes reports, insights and answers."""

    def __call__(self, ps):
        out = []
        for p in ps:
            if "rating from 0 to 10 and why" in p:
                out.append(json.dumps({"title": "T", "summary": "S", "rating": 5, "rating_explanation": "", "findings": [{"summary": "f", "explanation": "g"}]}))
            elif "reasoning, response and rating" in p:
                out.append(json.dumps({"reasoning": "", "response": "r", "rating": 4.5}))
            elif "JSON with response" in p:
                out.append(json.dumps({"response": "answer"}))
            elif "Merge these" in p:
                out.append(p.rpartition("TEXT:")[2])
            else:
                out += super().__call__([p])
        return out


def test_build_and_search(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    builder = build.Builder(Model(), lambda d: chunking.pack_chunks(d, 80), embedder=HashEmbedder(32))
    kg = build.KnowledgeGraph(builder, store, most_in_cluster=4)
    docs = spark.createDataFrame([("Alice meets Robert in Paris. Robert lives in Berlin with Clara.",), ("Clara writes to Alice. Paris is large.",)], "text string")
    kg.build(docs)
    names = {r["entity_name"] for r in store.load("entities").collect()}
    assert {"Alice", "Robert", "Paris", "Berlin", "Clara"} <= names
    n = store.load("relations").count()
    assert n > 0 and store.load("community_summaries").count() == store.load("communities").count() > 0
    first = store.current()
    kg.build(spark.createDataFrame([("Alice visits Dresden.",)], "text string"))
    assert store.current() != first and store.load("entities").where("entity_name = 'Dresden'").count() == 1
    assert store.load("relations").count() > n
    chunks = store.load("chunks")
    g = search.Graph(store.load("entities"), store.load("relations"), chunks, store.load("entity_vectors"), store.load("community_summaries"))
    local = search.LocalSearch(g, HashEmbedder(32), Model())
    assert local.search("Alice is mentioned", 5)["entities"].count() > 0
    assert local.query("Alice is mentioned", 5).first()["response"] == "answer"
    assert search.GlobalSearch(g, Model()).query("what?").first()["response"] == "answer"
    wide = search.BreadthFirstSearch(g, Model())
    assert {r["entity_name"] for r in wide.search("Where is Dresden?", 1)[0].collect()} >= {"Dresden"}
    write_gml(g.vertices, g.edges, str(tmp_path / "gml"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "gml")).collect()]
    assert sum(x.startswith("  node") for x in lines) == g.vertices.count() and "graph [" in lines
    nodes, links = read_gml(spark, str(tmp_path / "gml"))
    assert sorted(r["id"] for r in nodes.collect()) == sorted(r["id"] for r in g.vertices.collect()) and links.count() == g.edges.count()
    out = triplets.refine(docs.withColumn("doc_id", F.lit("d")), store.load("entity_vectors"), store.load("relation_vectors"), g.vertices, g.edges, lambda ps: [json.dumps([{"subject": "Alice", "relation": "knows", "object": "Robert"}])] * len(ps), HashEmbedder(32))
    assert {(r["subject"], r["object"]) for r in out.collect()} == {("Alice", "Robert")}
    assert triplets.refine(docs.withColumn("doc_id", F.lit("d")), g.entity_vectors, g.entity_vectors, g.vertices, g.edges, None, HashEmbedder(32)).count() == 0


def test_records(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    own = Records(store, HashEmbedder(32))
    people = spark.createDataFrame([(n, n.title(), "PERSON", f"{n} is here") for n in ("anna", "bert", "clara")], "id string, entity_name string, entity_type string, description string")
    none = F.array().cast("array<string>")
    people = people.withColumns({"source_chunk_id": F.array(F.lit("c")), "documents_id": none, "clusters": F.array().cast("array<struct<level:int,cluster_id:int>>")})
    own.add_entities(people)
    own.add_entities(people.where("id = 'anna'").withColumn("description", F.lit("!")))
    assert own.get_entity("anna").first()["description"] == "anna is here!"
    assert store.load("entity_vectors").count() == 3
    links = spark.createDataFrame([("ab", "anna", "bert", "Anna", "Bert", "knows", 4.0), ("bc", "bert", "clara", "Bert", "Clara", "sees", 2.0)], "id string, subject_id string, object_id string, subject_name string, object_name string, description string, relation_strength double")
    own.add_relations(links.withColumn("source_chunk_id", F.array(F.lit("c"))))
    own.add_relations(links.where("id = 'ab'").withColumns({"relation_strength": F.lit(2.0), "source_chunk_id": F.array(F.lit("d"))}))
    got = own.get_relations("bert", "anna").first()
    assert (got["relation_strength"], got["source_chunk_id"], got["description"]) == (3.0, ["c", "d"], "knowsknows")
    assert {r["other"] for r in own.entity_neighbours("bert").collect()} == {"anna", "clara"}
    assert {r["subject_label"] for r in own.entity_relations("bert").collect()} == {"Bert"}
    assert own.similar_entities("anna", 2).count() == 2 and "anna" not in {r["id"] for r in own.similar_entities("anna", 2).collect()}
    assert own.entities_like("clara is here", 1).first()["id"] == "clara"
    assert own.relations_like("sees", 1).first()["object_id"] == "clara"
    asked = spark.createDataFrame([(0, "bert"), (1, "nobody")], "pos int, id string")
    assert [r["entity_name"] for r in own.get_entities(asked).collect()] == ["Bert", None]
    own.update_entities(own.get_entity("clara").withColumn("description", F.lit("new")))
    assert own.get_entity("clara").first()["description"] == "new"
    own.delete_relations(spark.createDataFrame([("clara", "bert")], "u string, v string"))
    assert store.load("relations").count() == store.load("relation_vectors").count() == 1
    own.delete_entities(people.where("id = 'anna'"))
    assert (store.load("entities").count(), store.load("relations").count(), store.load("relation_vectors").count()) == (2, 0, 0)
    own.add_summaries(spark.createDataFrame([("com", "text"), ("no", None)], "id string, summary string"))
    assert own.get_summary("com").first()["summary"] == "text" and store.load("community_summaries").count() == 1
    own.delete_summaries(spark.createDataFrame([("com",)], "id string"))
    assert store.load("community_summaries").count() == 0


def test_settings(tmp_path):
    (tmp_path / ".env").write_text('# x\nLLM_MODEL_NAME="m"\nexport LLM_BASE_URL=http://h\n')
    own = Endpoint.load(str(tmp_path / ".env"))
    assert (own.model, own.url) == ("m", "http://h")


@dataclass
class Counting:
    """A model and an embedder that write down what they are asked."""

    folder: str
    dim: int = 16

    def _note(self, kind: str, inputs: list[str]) -> None:
        for x in inputs:
            with open(f"{self.folder}/{kind}", "a") as f:
                f.write(json.dumps(x) + "\n")

    def __call__(self, inputs: list[str]):
        if any("rating from 0 to 10 and why" in p for p in inputs):
            self._note("reports", inputs)
        return Model()(inputs)

    def embed(self, texts: list[str]):
        self._note("texts", texts)
        return HashEmbedder(self.dim)(texts)

    def asked(self, kind: str) -> list[str]:
        path = Path(f"{self.folder}/{kind}")
        out = [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
        path.unlink(missing_ok=True)
        return out


@dataclass
class CountingEmbedder:
    own: Counting
    dim: int = 16

    def __call__(self, texts: list[str]):
        return self.own.embed(texts)


def test_a_second_build_asks_only_for_what_is_new(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    own = Counting(str(tmp_path / "calls"))
    store = GraphStore(spark, str(tmp_path / "store"))
    kg = build.KnowledgeGraph(build.Builder(own, lambda d: chunking.pack_chunks(d, 80), embedder=CountingEmbedder(own)), store)
    kg.build(spark.createDataFrame([("Alice meets Robert.",), ("Clara writes to Dieter.",), ("Egon sees Frieda.",)], "text string"), "b1")
    texts, reports = own.asked("texts"), own.asked("reports")
    assert len(texts) == 9 and len(reports) == 3
    kg.build(spark.createDataFrame([("Robert calls Gustav.",)], "text string"), "b2")
    texts, reports = own.asked("texts"), own.asked("reports")
    assert sorted({t.split(" ")[0] for t in texts}) == ["Gustav", "Robert"] and len(texts) == 3  # two entities, one relation
    assert len(reports) == 1 and "Gustav" in reports[0]
    assert store.load("community_summaries").count() == store.load("communities").count() == 3
    assert store.load("entity_vectors").where("vector is not null").count() == store.load("entities").count() == 7
    now = store.current()
    assert kg.build(spark.createDataFrame([("Robert calls Gustav.",)], "text string"), "b2") == now == store.current()
    assert not own.asked("texts") and not own.asked("reports")


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    from graphloom.streaming.incremental import file_stream, grow

    spark.createDataFrame([("Anna meets Bertha.",)], "text string").write.parquet(str(tmp_path / "in"))
    kg = build.KnowledgeGraph(build.Builder(Model(), lambda d: chunking.pack_chunks(d, 80)), GraphStore(spark, str(tmp_path / "store")), reports=False)
    for _ in range(2):
        grow(file_stream(spark, str(tmp_path / "in"), "text string"), kg, str(tmp_path / "check")).awaitTermination()
        shutil.rmtree(tmp_path / "check" / "commits")  # as if the run had died before it wrote this down
    assert {r["description"] for r in kg.store.load("entities").collect()} == {"Anna is mentioned", "Bertha is mentioned"}
    assert kg.store.snapshots().count() == 1


def test_a_snapshot_writes_only_what_changed(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    one = spark.createDataFrame([("a", "x")], "id string, summary string")
    store.save(community_summaries=one, entities=spark.createDataFrame([("e",)], "id string"))
    second = store.save(community_summaries=one.withColumn("summary", F.lit("y")))
    assert sorted(p.name for p in (tmp_path / second).iterdir()) == ["community_summaries"]
    assert store.load("entities").count() == 1 and store.load("community_summaries").first()["summary"] == "y"


class Stub:
    """An endpoint that fails as told: a prompt's number of failures is behind its ``#``."""

    def __init__(self):
        self.seen, self.now, self.most, self.lock = Counter(), 0, 0, threading.Lock()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                text = body["messages"][-1]["content"] if "messages" in body else body["input"][0]
                with stub.lock:
                    stub.seen[text] += 1
                    stub.now += 1
                    stub.most = max(stub.most, stub.now)
                    bad = stub.seen[text] <= int(text.partition("#")[2] or 0)
                time.sleep(0.05)
                with stub.lock:
                    stub.now -= 1
                out = {"choices": [{"message": {"content": text.upper()}}], "data": [{"index": 0, "embedding": [1.0, 2.0]}]}
                self.send_response(500 if bad else 200)
                self.end_headers()
                self.wfile.write(json.dumps(out).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1"


def test_http_calls_are_tried_again_at_once_and_row_by_row(spark):
    stub = Stub()
    free = RateGate(None, None)
    model = Retrying(HttpModel(stub.url, "m", gate=free), 3, 0.01, 0.02)
    prompts_ = [f"p{i}" for i in range(30)] + ["once#1", "never#99"]
    rows = spark.createDataFrame([(p,) for p in prompts_], "p string").coalesce(1)
    got = {r["p"]: r for r in generate(rows, "p", "a", model, error="why", partitions=1).collect()}
    assert all(got[p]["a"] == p.upper() and got[p]["why"] is None for p in prompts_ if p != "never#99")
    assert got["never#99"]["a"] is None and "500" in got["never#99"]["why"]
    assert (stub.seen["once#1"], stub.seen["never#99"], stub.seen["p3"]) == (2, 3, 1)
    assert 2 <= stub.most <= 8
    vectors = embed(spark.createDataFrame([("a",), ("b",), ("bad#99",)], "t string").coalesce(1), "t", "v", HttpEmbedder(stub.url, "m", 2, gate=free), partitions=1).collect()
    assert {r["t"]: r["v"] for r in vectors} == {"a": [1.0, 2.0], "b": [1.0, 2.0], "bad#99": None}
    stub.server.shutdown()


def test_partitions_share_a_quota():
    own = shared(Retrying(HttpModel("http://x", "m", gate=RateGate(8, 60))), 4)
    assert (own.model.gate.per_second, own.model.gate.per_minute) == (2.0, 15.0)
    assert shared(HashEmbedder(4), 4) == HashEmbedder(4)


def test_tokenizers_of_libraries(spark):
    import public_tokenizers as public

    texts = ["The quick brown fox", "", None, "naïve café"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_file, by_ranks = FileTokenizer(public.path("byte_bpe_50k.json")), TiktokenTokenizer(ranks=public.path("byte_bpe_50k.tiktoken"), pattern=public.PATTERN)
    for own in (by_file, by_ranks):
        assert [r["t"] for r in truncate(df, "t", 2, own).collect()] == ["The quick", "", "", own.decode(own.encode("naïve café")[:2])]
    assert by_file.encode(texts[0]) == by_ranks.encode(texts[0])


def test_an_updated_prompt_is_used(spark):
    old = prompts.update("local_search", lambda query, context, language: F.concat(F.lit("MINE: "), query))
    try:
        v, e = path(spark)
        v = v.withColumns({"entity_type": F.lit("T"), "description": F.lit("d"), "source_chunk_id": F.array(F.lit("c"))})
        wide = search.BreadthFirstSearch(search.Graph(v, e), lambda ps: ["".join(ps)] * len(ps))
        assert wide.query("what is A?", 1).first()["response"] == "MINE: what is A?"
    finally:
        prompts.update("local_search", old)
    with pytest.raises(KeyError):
        prompts.update("none", old)


def test_top_k_by_probe_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((120, 3)), 1)
    x[50:60] = x[40]
    vectors = spark.createDataFrame([(f"v{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)] + [("none", None), ("short", [1.0])], "id string, vector array<double>")
    probes = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(20)] + [(98, [0.0, 0.0, 0.0]), (99, None)], "probe_id int, probe array<double>")
    want = {}
    for i in range(20):
        score = [(-round(float(u @ x[i] / np.linalg.norm(u) / np.linalg.norm(x[i])), 9), f"v{j:03d}") for j, u in enumerate(x) if np.linalg.norm(u) and np.linalg.norm(x[i])]
        for n, (s, j) in enumerate(sorted(score)[:7]):
            if -s >= 0.3:
                want[i, n + 1] = -s
    for block, rows in ((2048, 16_384), (3, 20)):
        got = similarity.top_k_by_probe(probes, vectors, 7, 0.3, block, rows).collect()
        assert {(r["probe_id"], r["rank"]): round(r["score"], 9) for r in got} == want


def test_empty_vectors_fall_back_to_the_records(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    people = spark.createDataFrame([(n, n, "PERSON", f"{n} sings") for n in ("anna", "bert", "clara")], "id string, entity_name string, entity_type string, description string")
    store.save(entities=people)
    assert Records(store, HashEmbedder(32)).similar_entities("anna", 2).count() == 2
    assert Records(store).similar_entities("anna", 2).count() == 0


def test_gml_with_all_attributes(spark, tmp_path):
    v = spark.createDataFrame([("a", 'Ann "&" Ö', "T", "one\ntwo", ["c1"], ["d"], [(0, 1)]), ("b", "Bob", "T", None, [], None, [])], "id string, entity_name string, entity_type string, description string, source_chunk_id array<string>, documents_id array<string>, clusters array<struct<level:int,cluster_id:int>>")
    e = spark.createDataFrame([("r", "b", "a", "Bob", "Ann", "likes [x]", 2.5, ["c1", "c2"])], "id string, subject_id string, object_id string, subject_name string, object_name string, description string, relation_strength double, source_chunk_id array<string>")
    write_gml(v, e, str(tmp_path / "g"))
    nodes, links = read_gml(spark, str(tmp_path / "g"))
    assert Counter(map(repr, nodes.select(*v.columns).collect())) == Counter(map(repr, v.collect()))
    assert links.select(*e.columns).collect() == e.collect()
    (tmp_path / "other.gml").write_text('Creator "x"\ngraph [\n  directed 0\n  node [\n    id 7\n    label "A&#246;"\n    graphics [ x 1.0 ]\n  ]\n  node [\n    id 9\n  ]\n  edge [\n    source 9\n    target 7\n    weight 3\n  ]\n]\n')
    nodes, links = read_gml(spark, str(tmp_path / "other.gml"))
    assert {r["id"] for r in nodes.collect()} == {"Aö", "9"}
    assert [(r["subject_id"], r["object_id"], r["relation_strength"]) for r in links.collect()] == [("9", "Aö", 3.0)]


def test_descriptions_by_cluster(spark):
    rows = [("A", "T", i, f"{'red apple' if i % 2 else 'blue whale'} {i}") for i in range(12)] + [("B", "T", 0, "alone")]
    df = spark.createDataFrame(rows, "entity_name string, entity_type string, pos int, description string").withColumns({"source_chunk_id": F.array(F.lit("c")), "documents_id": F.array(F.lit("d"))})
    got = merging.describe_clusters(merging.group_entities(df), HashEmbedder(64), lambda ps: [f"{p.count(chr(10))}" for p in ps], 5, 0.7)
    text = {r["entity_name"]: r["description"] for r in got.collect()}
    assert text["B"] == "alone" and text["A"].count(". ") == 1


def test_staged_extraction(spark):
    def model(ps):
        out = []
        for p in ps:
            if p.startswith("List"):
                out.append("Anna\n\n Bert ")
            elif p.startswith("Give"):
                out.append(p.split("ENTITY: ")[1].split("\n")[0])
            elif p.startswith("Describe"):
                out.append("someone")
            else:
                out.append("Нет связи" if "FIRST: Bert" in p else "- сестра")
        return out

    chunks = spark.createDataFrame([("c", "d", "Anna and Bert")], "id string, doc_id string, content string")
    e, r = extraction.extract_staged(chunks, model)
    assert sorted(x["entity_name"] for x in e.collect()) == ["Anna", "Bert"]
    assert [(x["subject_name"], x["object_name"], x["description"]) for x in r.collect()] == [("Anna", "Bert", "сестра")]


def test_growing_from_a_stream(spark, tmp_path):
    from graphloom.streaming.incremental import file_stream, grow

    spark.createDataFrame([("Anna meets Bertha. Bertha sees Clara.",)], "text string").write.parquet(str(tmp_path / "in"))
    kg = build.KnowledgeGraph(build.Builder(Model(), lambda d: chunking.pack_chunks(d, 80)), GraphStore(spark, str(tmp_path / "store")), reports=False)
    grow(file_stream(spark, str(tmp_path / "in"), "text string"), kg, str(tmp_path / "check")).awaitTermination()
    assert {r["entity_name"] for r in kg.store.load("entities").collect()} == {"Anna", "Bertha", "Clara"}
