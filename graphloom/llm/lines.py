"""Line dedup: a sharded minimal perfect hash that documents probe.

Keys of lines are counted once (one shuffle of 128-bit hashes, summed before
it, so a line that a third of all documents hold is a row per task). The
distinct hashes that more than one document holds are dealt into shards, and
each shard becomes a minimal perfect hash (:mod:`graphloom.llm.mph`) with
arrays of fingerprints, document counts and keepers; the counts decide which
lines go. Hashes of a single document, most of a corpus, have no entry: no
count could drop them, and they would make the index grow with all text. The
fingerprints must tell them from the others, so they have 64 bits; shorter
ones would drop lines that are unique.

The shards are broadcast only behind a check of their size. If all fit in
``MAX_INDEX_BYTES``, documents probe them where they are read, and texts
never move. A larger index stays where it is: 16-byte probes with the row and
line that they come from go to the shards, in blocks of ``PROBES``, so that a
line that everybody holds is many tasks; the marks come back by row and meet
the texts in one join. Either way the number of passes doesn't depend on the
size of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.llm.common import NULL_ID, id_or_least, materialize, schema_of, texts_to_python
from graphloom.llm.mph import Shard

MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Keys of a shard, about; 28 bytes each.
SHARD_KEYS = 32_768
LEAST_SHARDS = 64
#: An index that is broadcast is at most so large.
MAX_INDEX_BYTES = 64 << 20
#: Probes that meet a shard in one task, about.
PROBES = 500_000


def keyed(text: bytes | None, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(number, 128-bit key hash) of each line of a text whose key is long enough."""
    for i, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip().lower()  # of bytes: ASCII white space and letters only
            n = len(key)
            if n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                yield i, xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
    return both[::2], both[1::2]


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def repeated(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    """``h1, h2, n_documents, keeper`` of each key that ``min_documents`` documents or more hold; keeper is the largest id."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for key, text in zip(batch.column("key").to_pylist(), _texts(batch.column("text")), strict=True):
                own = {h for _, h in keyed(text, min_chars)}
                digests += own
                ids += [key] * len(own)
            h1, h2 = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], ["h1", "h2", "key"])

    rows = texts_to_python(docs).select(id_or_least(id_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(hashes, "h1 long, h2 long, key long")
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_documents"), F.max("key").alias("keeper")).where(F.col("n_documents") >= min_documents)


def index(keys: DataFrame) -> DataFrame:
    """``shard, n_shards, blob``: the perfect hash and arrays of each shard of ``keys``."""
    keys = materialize(keys)
    n_shards = max(LEAST_SHARDS, -(-keys.count() // SHARD_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        shard = Shard.build(h1, h2, counts=np.minimum(rows["n_documents"].to_numpy(), 2**32 - 1).astype(np.uint32), keepers=rows["keeper"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n_shards": [n_shards], "blob": [shard.dumps()]})

    return materialize(keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards))).groupBy("shard").applyInPandas(build, "shard long, n_shards long, blob binary"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, max_index_bytes: int = MAX_INDEX_BYTES, probes: int = PROBES) -> DataFrame:
    """``doc`` (a struct of the other columns), ``text`` without the dropped lines, ``n_lines``, ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. Keys of ``min_chars`` code points or more that
    ``min_documents`` documents or more hold lose all their lines except in
    the document with the largest id. Each row is a document; rows that share
    the largest id all keep the line. A null id is the least id. A null or
    empty text is one empty line and comes back as the empty text. An empty
    table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = texts_to_python(docs).select(F.struct(*others).alias("doc"), id_or_least(id_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shards = index(repeated(docs, id_col, text_col, min_chars, min(2, min_documents)))
    size = shards.agg(F.sum(F.length("blob"))).first()[0] or 0
    if size > max_index_bytes:
        return _dropped(_marked(rows, shards, min_chars, min_documents, probes))
    got = shards.collect()  # max_index_bytes at most
    held = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["blob"] for r in got})
    return _dropped(_probed(rows, held, got[0]["n_shards"] if got else 1, min_chars, min_documents))


def _probes(texts: list[bytes | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line, and both halves of the hash of each line with a key."""
    which, numbers, digests = [], [], []
    for d, text in enumerate(texts):
        for i, h in keyed(text, min_chars):
            which.append(d)
            numbers.append(i)
            digests.append(h)
    return np.array(which, np.int64), np.array(numbers, np.int32), *_halves(digests)


def _goes(shard: Shard, h1: np.ndarray, h2: np.ndarray, key: np.ndarray, min_documents: int) -> np.ndarray:
    """Whether lines of these hashes go from documents with these ids."""
    return (shard.find(h1, h2, "counts", 0) >= min_documents) & (shard.find(h1, h2, "keepers", NULL_ID) != key)


def _probed(rows: DataFrame, held, n_shards: int, min_chars: int, min_documents: int) -> DataFrame:
    """``rows`` with ``marks``, the numbers of the lines that go, by the shards in ``held``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard.loads(v) for k, v in held.value.items()}
        for batch in batches:
            texts, keys = _texts(batch.column("text")), batch.column("key").to_numpy()
            which, number, h1, h2 = _probes(texts, min_chars)
            gone = np.zeros(len(h1), bool)
            shard_of = (h1.view(np.int64) % n_shards).astype(np.int64)
            order = np.argsort(shard_of, kind="stable")
            present, starts = np.unique(shard_of[order], return_index=True)
            for s, at in zip(present.tolist(), np.split(order, starts[1:]), strict=True):
                if s in shards:
                    gone[at] = _goes(shards[s], h1[at], h2[at], keys[which[at]], min_documents)
            cuts = np.searchsorted(which[gone], np.arange(len(texts) + 1)).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(cuts), pa.array(number[gone]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "key", "text")], marks], ["doc", "key", "text", "marks"])

    return rows.mapInArrow(mark, schema_of(rows, "doc", "key", "text", marks=T.ArrayType(T.IntegerType())))


def _marked(rows: DataFrame, shards: DataFrame, min_chars: int, min_documents: int, probes: int) -> DataFrame:
    """The same for an index of any size: probes go to the shards, marks come back."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    n_shards = shards.select("n_shards").first()[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, number, h1, h2 = _probes(_texts(batch.column("text")), min_chars)
            of = pa.array(which)
            h1 = h1.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h1 % n_shards), pa.array(h1), pa.array(h2.view(np.int64)), batch.column("key").take(of), batch.column("row").take(of), pa.array(number)], ["shard", "h1", "h2", "key", "row", "line"])

    asked = rows.select("key", "row", "text").mapInArrow(ask, "shard long, h1 long, h2 long, key long, row long, line int")
    blocks = materialize(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / probes).alias("blocks")))
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks")
    copies = shards.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "line": pa.array([], pa.int32())})
        h1, h2 = (left.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        gone = _goes(Shard.loads(right.column("blob")[0].as_py()), h1, h2, left.column("key").to_numpy(), min_documents)
        return left.select(["row", "line"]).filter(pa.array(gone))

    met = asked.groupBy("shard", "block").cogroup(copies.select("shard", "block", "blob").groupBy("shard", "block")).applyInArrow(meet, "row long, line int")
    marks = met.groupBy("row").agg(F.collect_list("line").alias("marks"))  # a document's own lines
    return rows.join(marks, "row", "left").select("doc", "key", "text", "marks")


def _dropped(rows: DataFrame) -> DataFrame:
    """``doc, text, n_lines, n_dropped``: the texts without the lines in ``marks``."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, marks in zip(_texts(batch.column("text")), batch.column("marks").to_pylist(), strict=True):
                n_lines.append((text or b"").count(b"\n") + 1)
                n_dropped.append(len(marks or ()))
                if marks:
                    gone = set(marks)
                    text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone])
                kept.append(text or b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(drop, schema_of(rows, "doc", text=T.StringType(), n_lines=T.LongType(), n_dropped=T.LongType()))
