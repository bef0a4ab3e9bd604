"""Chunkers: one document in, many chunks out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions import text as X
from graphloom.functions.batches import in_small_batches
from graphloom.schemas import chunk_id


class Chunker(Protocol):
    """``doc_id, text`` -> chunks (:data:`graphloom.schemas.CHUNK`)."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def _numbered(docs: DataFrame, pieces) -> DataFrame:
    """Chunks from an array column, with their order in the document."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(pieces).alias("chunk_order_idx", "content"))
    return rows.select(chunk_id(F.col("content")).alias("id"), "content", "chunk_order_idx", "doc_id", F.lit(None).cast("int").alias("num_tokens"))


def document_ids(docs: DataFrame) -> DataFrame:
    """Documents under the MD5 of their text."""
    return docs.withColumn("doc_id", F.md5("text"))


def pack_chunks(docs: DataFrame, most: int, overlap: int = 0) -> DataFrame:
    """Greedy packing of sentences into chunks of ``most`` characters."""
    return _numbered(docs, X.pack(X.sentences(F.col("text")), most, overlap))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One chunk per id: the last in the order of (doc_id, chunk_order_idx)."""
    last = W.partitionBy("id").orderBy(F.desc("doc_id"), F.desc("chunk_order_idx"))
    return chunks.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def hashed_embedding(sentences: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors from character trigrams: a deterministic stand-in for an embedding model."""
    import zlib

    out = np.zeros((len(sentences), dim))
    for i, s in enumerate(sentences):
        low = f" {s.lower()} "
        for j in range(len(low) - 2):
            h = zlib.crc32(low[j : j + 3].encode())
            out[i, h % dim] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def split_weakest(pieces: list[str], near: np.ndarray, size: Callable[[str], int], most: int) -> list[str]:
    """Splits where neighbours are least alike (the first such place) until every part fits; a single piece stays whole."""
    out: list[str] = []
    stack = [(0, len(pieces))]
    while stack:
        a, b = stack.pop()
        joined = " ".join(pieces[a:b])
        if b - a <= 1 or size(joined) <= most:
            out.append(joined)
            continue
        cut = a + 1 + int(np.argmin(near[a : b - 1]))
        stack += [(cut, b), (a, cut)]
    return [s for s in out if s]


def semantic_chunks(docs: DataFrame, most: int, embed: Callable[[list[str]], np.ndarray] = hashed_embedding, size: Callable[[str], int] = lambda s: len(s.split())) -> DataFrame:
    """Chunks of at most ``most`` tokens, split where neighbouring sentences are least alike."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for own in batch["pieces"]:
                own = list(own) if own is not None else []
                e = embed(own) if own else np.zeros((0, 1))
                parts.append(split_weakest(own, (e[:-1] * e[1:]).sum(axis=1), size, most) if own else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "parts": parts})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), X.sentences(F.col("text")).alias("pieces"))
    return _numbered(in_small_batches(rows).mapInPandas(split, "doc_id string, parts array<string>"), F.col("parts"))


def scored_chunks(docs: DataFrame, most: int, score: Callable[[str, str], float]) -> DataFrame:
    """Chunks of at most ``most`` characters, split where a scorer of neighbouring sentences (a reranker) is lowest."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for own in batch["pieces"]:
                own = list(own) if own is not None else []
                near = np.array([score(a, b) for a, b in zip(own, own[1:], strict=False)])
                parts.append(split_weakest(own, near, len, most) if own else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "parts": parts})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), X.sentences(F.col("text")).alias("pieces"))
    return _numbered(in_small_batches(rows).mapInPandas(split, "doc_id string, parts array<string>"), F.col("parts"))


def neighbour_similarity(vectors: DataFrame) -> DataFrame:
    """``doc_id, pos, near``: the inner product of each sentence's vector with the next one's."""
    from graphloom.functions.linear import dot

    after = F.lead("vector").over(W.partitionBy("doc_id").orderBy("pos"))
    return vectors.withColumn("near", dot(F.col("vector"), after)).where("near is not null").select("doc_id", "pos", "near")
