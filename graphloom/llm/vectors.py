"""Vectors as rows: checked, packed into bytes, and grouped into classes of equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from graphloom.llm.common import id_or_least, materialize

#: Kept ids of a class are merged in rounds of so many.
FAN_IN = 8


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``key`` (the id, null as the least), ``dim``, ``norm``, ``vec`` (its components as bytes, in single precision
    if the column is) and ``tag`` (128 bits that name equal vectors); all but the key are null if the vector takes no part.

    Vectors that are null, empty or zero, or hold a null or non-finite
    component, take no part.
    """
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    kept = np.dtype(np.float32 if single else np.float64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat = column.values.to_numpy(zero_copy_only=False).astype(kept)
            at, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            out, dims, norms = [], [], []
            width = int(at[1] - at[0]) if batch.num_rows else 0
            if width and there.all() and (np.diff(at) == width).all():  # all at once
                x = flat[at[0] : at[-1]].reshape(-1, width).astype(np.float64)
                fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
                held = flat[at[0] : at[-1]].tobytes()
                step = width * kept.itemsize
                out = [held[i * step : (i + 1) * step] if ok else None for i, ok in enumerate(fine.tolist())]
                dims = [width if ok else None for ok in fine.tolist()]
                norms = [n if ok else None for n, ok in zip(np.linalg.norm(np.where(fine[:, None], x, 0), axis=1).tolist(), fine.tolist(), strict=True)]
                at = at[:1]
            for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), there.tolist(), strict=False):
                v = flat[a:b].astype(np.float64)
                ok = ok and b > a and bool(np.isfinite(v).all() and v.any())
                out.append(flat[a:b].tobytes() if ok else None)
                dims.append(b - a if ok else None)
                norms.append(float(np.linalg.norm(v)) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(out, pa.binary())], ["key", "dim", "norm", "vec"])

    given = vectors.select(id_or_least(id_col).alias("key"), F.col(f"`{vector_col}`").cast("array<float>" if single else "array<double>").alias("v"))
    return given.mapInArrow(rows, "key long, dim int, norm double, vec binary").withColumn("tag", F.unhex(F.md5("vec")))


def classes(rows: DataFrame) -> DataFrame:
    """``node, tag, dim, norm, vec, n, least``: the distinct vectors, with their count and least key."""
    own = rows.where(F.col("vec").isNotNull()).groupBy("tag")
    own = own.agg(*[F.first(c).alias(c) for c in ("dim", "norm", "vec")], F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    return materialize(own.withColumn("node", F.monotonically_increasing_id()))


def smallest(rows: DataFrame, k: int) -> DataFrame:
    """``node, keys``: the k least keys of each node, ascending, as often as rows have them.

    They are merged in rounds by salts of the keys, so that a node with a
    third of all rows is never gathered in one task.
    """
    own = rows.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(FAN_IN**3)))
    for _ in range(4):
        nth = F.row_number().over(W.partitionBy("node", "salt").orderBy("key"))
        own = own.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth").withColumn("salt", F.floor(F.col("salt") / FAN_IN))
    often = F.array_repeat("key", F.least("n", F.lit(k)).cast("int"))
    return own.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list(often))), 1, k).alias("keys"))


def sampled(own: DataFrame, total: int, size: int) -> DataFrame:
    """About ``size`` of ``total`` distinct vectors (all, if there are no more), chosen by hash; the same at every run."""
    return own if total <= size else own.where(F.pmod(F.xxhash64("tag"), F.lit(total)) < size)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Packed vectors of one length as a matrix in double precision."""
    held = b"".join(column.to_pylist())
    single = len(held) == 4 * dim * len(column)
    return np.frombuffer(held, np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)
