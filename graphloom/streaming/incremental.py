"""Growing a graph from streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.merging import upsert
from graphloom.plans.build import KnowledgeGraph


def grow(documents: DataFrame, graph: KnowledgeGraph, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch of a stream of documents (``text``) to a graph; a batch is one snapshot, and one that is replayed adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            graph.build(batch, f"{checkpoint}#{number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, key: str = "id", order: str | None = None) -> StreamingQuery:
    """Upserts each micro-batch by key: the last by ``order`` wins. ``save`` gets the batch number, to write a batch once."""

    def add(batch: DataFrame, number: int) -> None:
        save(upsert(load(), batch, key, order), number)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
