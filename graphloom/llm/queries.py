"""The thin queries that apply each corpus operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm import ann, chat, lines, metric_join, mixing, packing, pii, secrets, simhash, toxicity
from graphloom.llm.common import null_id_back, table
from graphloom.llm.oracles import CHAT_SQL, LINES_SQL, MIX_SQL


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20: query_id, rank, vec_id, score."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "key % 20 = 0")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors: vec_id, n_links, component_id, kept."""
    rows = metric_join.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select(null_id_back("key").alias("vec_id"), "n_links", null_id_back("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share, dropped from all but one: doc_id, n_lines, n_dropped, kept_sha256."""
    rows = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, rebuilt from event logs, rendered and read back: conv_id, n_turns and digests."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digests(chat.render(chat.rebuilt(turns.unionByName(more))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc.doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return _span_digest(secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text")), secrets.KINDS[:3])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return _span_digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")), pii.KINDS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).select("doc.doc_id", "score")
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: doc_id, fingerprint, component_id."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select(null_id_back("key").alias("doc_id"), hexed.alias("fingerprint"), null_id_back("component").alias("component_id"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each: doc_id, size, source_size, target, taken."""
    rows = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": op1_neighbours,
        "op2_near_vectors": op2_near_vectors,
        "op3_line_dedup": op3_line_dedup,
        "op4_chat": op4_chat,
        "op5_secrets": op5_secrets,
        "op6_pii": op6_pii,
        "op7_toxicity": op7_toxicity,
        "op8_simhash": op8_simhash,
        "op9_mix_sources": op9_mix_sources,
        "op10_pack": op10_pack,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": LINES_SQL,
        "op4_chat": CHAT_SQL,
        "op9_mix_sources": MIX_SQL,
    }
