"""Tables of a graph under one folder, in snapshots.

A snapshot writes the tables that it changes under a new name; a line of the
manifest, written after them, says where each table of the snapshot lies, so
a reader never sees half of one and unchanged tables are not copied.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom import schemas as S
from graphloom.operators.chunking import dedup_chunks
from graphloom.operators.ranking import numbered

TABLES: dict[str, T.StructType] = {
    "chunks": S.CHUNK, "entities": S.ENTITY, "relations": S.RELATION, "entity_vectors": S.VECTOR,
    "relation_vectors": T.StructType([*S.VECTOR.fields, T.StructField("subject", T.StringType()), T.StructField("object", T.StringType())]),
    "communities": S.COMMUNITY, "community_summaries": S.SUMMARY, "report_cache": S.record(hash=S.S, summary=S.S),
}
MANIFEST = "at timestamp, number long, snapshot string, batch string, tables map<string,string>"


@dataclass
class GraphStore:
    """The tables of a graph at a path that Spark can write. One writer at a time."""

    spark: SparkSession
    path: str

    def snapshots(self) -> DataFrame:
        """``at, number, snapshot, batch, tables``, as far as they were finished."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def _last(self):
        return self.snapshots().orderBy(F.desc("number"), F.desc("at"), "snapshot").first()

    def current(self) -> str | None:
        row = self._last()
        return row["snapshot"] if row else None

    def has_batch(self, batch: str) -> bool:
        """Whether a snapshot of this batch was finished."""
        return not self.snapshots().where(F.col("batch") == batch).isEmpty()

    def load(self, name: str) -> DataFrame:
        """A table of the last snapshot; empty if there is none."""
        row = self._last()
        if row is None or name not in row["tables"]:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{row['tables'][name]}/{name}")

    def save(self, batch: str | None = None, **tables: DataFrame) -> str:
        """A new snapshot of the given tables; the others stay where they are."""
        last = self._last()
        name = f"snapshot-{uuid.uuid4().hex}"
        places = dict(last["tables"]) if last else {}
        for t, df in tables.items():
            schema = TABLES[t]
            if t == "chunks":
                df = dedup_chunks(df)
            if t == "communities":
                df = df.withColumns({c: F.array_distinct(c) for c in ("entity_ids", "relation_ids")})
            missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
            df.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(f"{self.path}/{name}/{t}")
            places[t] = name
        row = [((last["number"] if last else 0) + 1, name, batch, places)]
        line = self.spark.createDataFrame(row, "number long, snapshot string, batch string, tables map<string,string>").coalesce(1)
        line.select(F.current_timestamp().alias("at"), "*").write.mode("append").json(f"{self.path}/manifest")
        return name


def _gml_text(value) -> str:
    return '"' + "".join(c if 32 <= ord(c) < 127 and c not in '"&' else f"&#{ord(c)};" for c in str(value)) + '"'


def _gml_lines(rows: DataFrame, head: str, numbers: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """``value``: a record of each row on a line; numbers as they are, all else as text (null: left out)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = []
            for row in own.to_dict("records"):
                parts = [f"{k} {row[k]}" for k in numbers] + [f"{k.replace('_', '')} {_gml_text(row[k])}" for k in texts if row[k] is not None]
                out.append(f"  {head} [ {' '.join(parts)} ]")
            yield pd.DataFrame({"value": out})

    return rows.select(*numbers, *texts).mapInPandas(write, "value string")


#: Attributes that records have in the file, beside what makes the graph.
NODE_TEXTS = ("label", "entity_name", "entity_type", "description", "sources", "documents", "clusters")
EDGE_TEXTS = ("label", "subject_name", "object_name", "description", "sources")


def write_gml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph in GML that other tools read, with all attributes; parts of the folder in order make the file.

    Nodes are numbered in the order of their ids; lists are written as JSON.
    """

    def with_all(df: DataFrame, **also: str) -> DataFrame:
        lists = {new: F.to_json(old) if old in df.columns else F.lit(None).cast("string") for new, old in also.items()}
        names = {c: F.lit(None).cast("string") for c in ("entity_name", "entity_type", "description", "subject_name", "object_name") if c not in df.columns}
        return df.withColumns({**lists, **names})

    v = numbered(with_all(vertices.where("id is not null"), sources="source_chunk_id", documents="documents_id", clusters="clusters").withColumn("label", F.col("id")), [F.col("id")], "number")
    nodes = _gml_lines(v.withColumn("id", F.col("number") - 1), "node", ("id",), NODE_TEXTS)
    e = with_all(edges, sources="source_chunk_id").withColumn("label", F.col("id") if "id" in edges.columns else F.lit(None).cast("string"))
    for side, end in (("subject", "source"), ("object", "target")):
        e = e.join(v.select(F.col("label").alias(f"{side}_id"), (F.col("number") - 1).alias(end)), f"{side}_id")
    links = _gml_lines(e.withColumn("weight", F.coalesce("relation_strength", F.lit(1.0))), "edge", ("source", "target", "weight"), EDGE_TEXTS)
    frame = vertices.sparkSession.createDataFrame([("graph [", 0), ("]", 3)], "value string, o int")
    rows = frame.unionByName(nodes.withColumn("o", F.lit(1))).unionByName(links.withColumn("o", F.lit(2)))
    rows.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


_GML = re.compile(r'"[^"]*"|\[|\]|[^\s\[\]"]+')


def gml_records(text: str) -> Iterator[tuple[str, dict]]:
    """(node or edge, attributes) of GML text; records in records are passed over."""
    depth: list[str] = []
    own: dict = {}
    key = None
    for m in _GML.finditer(text):
        x = m[0]
        if x == "[":
            depth.append(key or "")
            if key in ("node", "edge"):
                own = {}
            key = None
        elif x == "]":
            if depth and depth.pop() in ("node", "edge"):
                yield "edge" if "source" in own else "node", own
            key = None
        elif key is None:
            key = x
        else:
            if depth and depth[-1] in ("node", "edge"):
                own[key] = html.unescape(x[1:-1]) if x.startswith('"') else x
            key = None


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertices`` and ``edges`` of GML files, with the attributes that :func:`write_gml` writes as far as they are there.

    Its own files, a record on a line, are read line by line; others whole,
    file by file. A node without a label has its number as id.
    """
    lines = spark.read.text(path)
    own_lines = lines.where(F.col("value").startswith("  node [ id ")).limit(1).count() > 0
    texts = lines if own_lines else spark.read.text(path, wholetext=True)
    names = [*NODE_TEXTS, *[c for c in EDGE_TEXTS if c not in NODE_TEXTS], "id", "source", "target", "weight"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(kind, own) for text in batch["value"] for kind, own in gml_records(text)]
            yield pd.DataFrame({"kind": [k for k, _ in found], **{n: [o.get(n.replace("_", "")) for _, o in found] for n in names}}, dtype=object)

    rows = texts.mapInPandas(read, ", ".join(f"{n} string" for n in ["kind", *names]))
    nodes = rows.where("kind = 'node'").withColumn("number", F.col("id")).withColumn("id", F.coalesce("label", "id"))
    strings = T.ArrayType(T.StringType())
    vertices = nodes.select("id", F.coalesce("entity_name", "id").alias("entity_name"), "entity_type", "description", F.from_json("sources", strings).alias("source_chunk_id"), F.from_json("documents", strings).alias("documents_id"), F.from_json("clusters", S.ENTITY["clusters"].dataType).alias("clusters"))
    ends = nodes.select("number", F.col("id").alias("end"))
    edges = rows.where("kind = 'edge'").withColumn("id", F.col("label"))
    for side, end in (("subject", "source"), ("object", "target")):
        edges = edges.join(ends.select(F.col("number").alias(end), F.col("end").alias(f"{side}_id")), end)
    edges = edges.select("id", "subject_id", "object_id", "subject_name", "object_name", "description", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("relation_strength"), F.from_json("sources", strings).alias("source_chunk_id"))
    return vertices, edges
