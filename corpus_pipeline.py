"""A training corpus from documents: five stages, each written as Parquet and read again.

Every stage works on all that its predecessor kept. All but the last return
the columns of ``documents``; the last returns the pieces of packed windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import lines, mixing, packing, simhash, toxicity
from graphloom.llm.common import table
from graphloom.plans.lineage import checkpoint_folder

#: Documents with this score or more are rejected.
TOXIC = 0.5


def _with_text(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of the documents, from ``doc`` and the (new) ``text``; ``n_chars`` follows the text."""
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[own[c].alias(c) if c in own else F.col(f"doc.`{c}`") for c in names])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below :data:`TOXIC`.

    Null and empty texts hold no words and stay. Each row is judged by its
    own text, so rows that repeat or share an id, null ids among them, go or
    stay alike only if their texts do. Labels without a document teach
    nothing. An empty table gives no rows. Columns stay as they are, whatever
    their names.
    """
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, scorer, keep_text=True).where(F.col("score") < TOXIC)
    return rows.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share, except in the last that holds each.

    All rows stay, also those left without text. A null text comes back
    empty. A null id is the least; rows that share the largest id all keep a
    line, and repeated rows count as documents each. ``n_chars`` follows the
    text. An empty table gives no rows.
    """
    return _with_text(lines.dedup_lines(docs), docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by id (null first), fingerprint, text and other columns (null first).

    Groups are of texts, by links of fingerprints; rows that share an id,
    null or not, but are no near copies are groups of their own. Null, empty
    and blank texts are one group. Repeated rows are copies. An empty table
    gives no rows.
    """
    rows = simhash.grouped(docs.select("doc_id", "text"))
    kept = rows.groupBy("root").agg(F.min(F.struct("key", "fp")).alias("least")).select("least.*")
    own = simhash.with_fingerprints(docs).join(kept, ["key", "fp"], "left_semi")
    order = ["text", *[c for c in docs.columns if c != "text"]]
    first = own.groupBy("key", "fp").agg(F.min(F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in order])).alias("doc"))
    return first.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it.

    Null and empty texts have no words and only a source's whole copies. A
    null source is a source. Rows that share an id are documents of their
    own; of repeated rows as many are taken as there is room for. An empty
    table gives no rows.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone; null ids stay null; rows
    that repeat or share an id are packed each. An empty table gives no rows.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_once),
    ("simhash_near_dedup", near_copies_out),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express scoring, fingerprints or packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
