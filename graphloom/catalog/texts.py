"""Queries on texts: ids, sentences, chunks, tokens, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom import prompts
from graphloom.catalog import fixtures as X
from graphloom.catalog.registry import query, table
from graphloom.functions import text as T
from graphloom.operators.chunking import dedup_chunks, document_ids, pack_chunks, semantic_chunks
from graphloom.plans.build import tokens_kept
from graphloom.schemas import chunk_id

BLANKS = "chr(32) || chr(10) || chr(9) || chr(13)"
SENTENCES = rf"""sents AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS list FROM documents),
sent AS (SELECT doc_id, unnest(list) AS s, generate_subscripts(list, 1) AS pos FROM sents)"""


def pack_sql(most: int, overlap: int) -> str:
    head = f"CASE WHEN coalesce(done, last) IS NOT NULL THEN right(coalesce(done, last), {overlap}) || ' ' ELSE '' END ||" if overlap else ""
    return f"""WITH RECURSIVE {SENTENCES},
fold AS (
  SELECT doc_id, 0::BIGINT AS pos, '' AS cur, NULL::VARCHAR AS done, NULL::VARCHAR AS last FROM documents
  UNION ALL
  SELECT doc_id, pos, CASE WHEN fits THEN cur || s || ' ' ELSE {head} s || ' ' END, done, coalesce(done, last)
  FROM (SELECT f.doc_id, t.pos, f.cur, f.last, t.s, length(f.cur) + length(t.s) <= {most} AS fits,
               CASE WHEN length(f.cur) + length(t.s) <= {most} THEN NULL ELSE nullif(trim(f.cur, {BLANKS}), '') END AS done
        FROM fold f JOIN sent t ON t.doc_id = f.doc_id AND t.pos = f.pos + 1)),
ends AS (SELECT doc_id, 2 * pos AS o, done AS content FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, 2 * pos + 1, trim(cur, {BLANKS}) FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1)
SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS chunk_order_idx, 'chunk-' || md5(content) AS id, length(content)::INT AS chars
FROM ends WHERE content <> ''"""


@query(f"WITH {X.VERTICES} SELECT id, entity_name, entity_type FROM vertices")
def ids_entity(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all entities."""
    return X.vertices(spark, d).select("id", "entity_name", "entity_type")


@query(f"WITH {X.GRAPH} SELECT id, subject_id, object_id FROM edges")
def ids_relation(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all relations."""
    return X.edges(spark, d).select("id", "subject_id", "object_id")


@query("SELECT doc_id, md5(text) AS document_id, 'chunk-' || md5(text) AS chunk_id FROM documents")
def ids_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Ids of documents and of chunks of their whole texts."""
    docs = table(spark, d, "documents")
    return document_ids(docs.withColumnRenamed("doc_id", "n")).select(F.col("n").alias("doc_id"), F.col("doc_id").alias("document_id"), chunk_id(F.col("text")).alias("chunk_id"))


@query(f"WITH {SENTENCES} SELECT doc_id, (pos - 1)::INT AS pos, md5(s) AS hash, length(s)::INT AS chars FROM sent")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """All sentences of all documents."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.md5("s").alias("hash"), F.length("s").alias("chars"))


def _packed(spark: SparkSession, d: str, most: int, overlap: int) -> DataFrame:
    rows = pack_chunks(table(spark, d, "documents").select("doc_id", "text"), most, overlap)
    return rows.select("doc_id", "chunk_order_idx", "id", F.length("content").alias("chars"))


@query(pack_sql(2048, 0))
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed greedily into chunks of 2048 characters."""
    return _packed(spark, d, 2048, 0)


@query(pack_sql(512, 32))
def chunk_pack_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The same at 512 characters, with an overlap of 32."""
    return _packed(spark, d, 512, 32)


@query("SELECT 'chunk-' || md5(text) AS id, doc_id::VARCHAR AS doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id::VARCHAR DESC) = 1")
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, the last of each content."""
    docs = table(spark, d, "documents")
    return dedup_chunks(docs.select(chunk_id(F.col("text")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_order_idx"))).select("id", "doc_id")


@query()
def semantic_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 120 words at most, split where neighbouring sentences are least alike."""
    return semantic_chunks(table(spark, d, "documents").select("doc_id", "text"), 120).select("doc_id", "chunk_order_idx", "id")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS list FROM documents)
SELECT doc_id, len(list)::INT AS n_tokens, md5(array_to_string(list[1:50], ' ')) AS hash FROM t""")
def token_truncate(spark: SparkSession, d: str) -> DataFrame:
    """All texts cut to 50 tokens, and how many they had."""
    rows = tokens_kept(table(spark, d, "documents").select("doc_id", "text"), "text", 50)
    return rows.select("doc_id", "n_tokens", F.md5("text").alias("hash"))


@query(f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS list FROM documents)
SELECT doc_id, len(list)::INT AS n_lines, md5(array_to_string(list, '|')) AS hash FROM t""")
def nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    """The stripped, non-blank lines of all texts."""
    rows = table(spark, d, "documents").select("doc_id", T.lines(F.col("text")).alias("own"))
    return rows.select("doc_id", F.size("own").alias("n_lines"), F.md5(F.array_join("own", "|")).alias("hash"))


@query("""WITH t AS (SELECT p_partkey, trim(regexp_replace(p_name, '[[:punct:]]', '', 'g'), chr(32) || chr(10) || chr(9) || chr(13)) AS clean FROM part),
w AS (SELECT *, list_filter(string_split_regex(clean, '\\s+'), lambda x: x <> '') AS words FROM t),
m AS (SELECT p_partkey, words, unnest(range(1, (1 << len(words))::BIGINT)) AS mask FROM w WHERE len(words) > 0),
c AS (SELECT p_partkey, array_to_string(list_filter(words, lambda x, i: ((mask >> (i - 1)) & 1) = 1), ' ') AS phrase FROM m)
SELECT DISTINCT p_partkey, phrase FROM (SELECT * FROM c UNION ALL SELECT p_partkey, clean FROM w)""")
def word_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Every choice of the words of each part's name, in order."""
    return table(spark, d, "part").select("p_partkey", F.explode(T.phrases(F.col("p_name"))).alias("phrase"))


@query("SELECT doc_id, md5('List the named entities of the text, one per line.' || chr(10) || 'TEXT:' || coalesce(text, '')) AS hash FROM documents")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """The prompt for the mentions of each document."""
    return table(spark, d, "documents").select("doc_id", F.md5(prompts.render("list_mentions", F.col("text"))).alias("hash"))
