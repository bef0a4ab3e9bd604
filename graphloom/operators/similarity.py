"""Vector top-k and what is joined to it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.linear import cosine, soft_cosine

#: Probes and vectors of one task, about.
PROBES, ROWS = 2_048, 16_384


def top_k(vectors: DataFrame, probe: list[float] | Column, k: int = 5, threshold: float | None = None, soft: bool = False) -> DataFrame:
    """The k rows (id, vector, ...) nearest to a probe by cosine, with ``score`` and ``rank`` from 1; then those below the threshold go.

    A heap per task and a merge of k rows per task: the table isn't sorted.
    """
    to = probe if isinstance(probe, Column) else F.array(*[F.lit(float(x)) for x in probe])
    score = (soft_cosine if soft else cosine)(F.col("vector"), to)
    best = vectors.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "id").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("score") >= threshold) if threshold is not None else ranked


def top_k_by_probe(probes: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, block: int = PROBES, rows: int = ROWS) -> DataFrame:
    """``probe_id, id, score, rank``: the k nearest rows to each probe (``probe_id, probe``) by cosine.

    Blocks of probes meet blocks of vectors, a task each: one matrix product,
    of which the best k of every probe leave the task. Probes without a
    direction, or of another length than the vectors, find nothing.
    """
    asked = probes.select("probe_id", F.col("probe").cast("array<double>").alias("vector")).where("vector is not null")
    held = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    n_asked, n_held = (max(1, -(-df.count() // most)) for df, most in ((asked, block), (held, rows)))
    deal = F.pmod(F.xxhash64("vector"), F.lit(n_asked))
    asked = asked.withColumn("a", deal).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_held - 1).cast("long"))))
    held = held.withColumn("b", F.pmod(F.xxhash64("vector", "id"), F.lit(n_held))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))))
    kinds = {f.name: f.dataType.simpleString() for f in [*probes.schema.fields, *vectors.schema.fields]}

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        dims = right["vector"].map(len)
        for dim, own in left.groupby(left["vector"].map(len)):
            near = right[dims == dim].sort_values("id", kind="stable")
            if not len(near) or not dim:
                continue
            p, x = (np.array(df["vector"].tolist(), float) for df in (own, near))
            size = np.outer(np.linalg.norm(p, axis=1), np.linalg.norm(x, axis=1))
            score = np.where(size > 0, (p @ x.T) / np.where(size > 0, size, 1), -np.inf)
            score[~np.isfinite(score) | (score < (-np.inf if threshold is None else threshold))] = -np.inf
            if score.shape[1] > k:
                edge = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
                score[score < edge] = -np.inf
            i, j = np.nonzero(np.isfinite(score))
            order = np.lexsort((j, -score[i, j], i))  # ties go to the smaller id
            i, j = i[order], j[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < k], j[nth < k]
            out.append(pd.DataFrame({"probe_id": own["probe_id"].to_numpy()[i], "id": near["id"].to_numpy()[j], "score": score[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"probe_id": [], "id": [], "score": []})

    found = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInPandas(best, f"probe_id {kinds['probe_id']}, id {kinds['id']}, score double")
    nth = F.row_number().over(W.partitionBy("probe_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def similar_to(vectors: DataFrame, own_id: str, probe: Column | list[float], records: DataFrame, k: int = 5, fallback: DataFrame | None = None) -> DataFrame:
    """The records of the k nearest other rows: one more is searched, and the row itself goes; hits without a record vanish after that.

    If the vectors give no hit, those of ``fallback`` (id, vector) are
    searched by the soft cosine, as far as they have a direction.
    """
    hits = _hits(vectors, probe, k, fallback).select("id", "score", "rank")
    return hits.join(records, "id").where(F.col("id") != own_id).orderBy("rank").limit(k)


def _hits(vectors: DataFrame, probe: Column | list[float], k: int, fallback: DataFrame | None) -> DataFrame:
    hits = top_k(vectors, probe, k + 1)
    return top_k(fallback, probe, k + 1, soft=True) if fallback is not None and hits.isEmpty() else hits


def similar_relations(vectors: DataFrame, own_id: str, probe: Column | list[float], edges: DataFrame, k: int = 5, fallback: DataFrame | None = None) -> DataFrame:
    """The relations behind the k nearest other relation vectors (id, subject, object, vector), by pair in either direction, else by id.

    ``fallback`` has the same columns and is searched as in :func:`similar_to`.
    """
    hits = _hits(vectors, probe, k, fallback).select(F.col("id").alias("hit"), "subject", "object", "score", "rank")
    hits = hits.where(F.col("hit") != own_id).withColumns({"u": F.least("subject", "object"), "v": F.greatest("subject", "object")})
    own = edges.withColumns({"u": F.least("subject_id", "object_id"), "v": F.greatest("subject_id", "object_id")})
    # one of the two conditions holds for a hit, as its ends are known or not
    by_pair = hits.where("u is not null and v is not null").join(own, ["u", "v"])
    by_id = hits.where("u is null or v is null").drop("u", "v").join(own, F.col("hit") == F.col("id"))
    return by_pair.unionByName(by_id.select(by_pair.columns)).where(F.col("id") != own_id).orderBy("rank", "id").limit(k)


def candidates(terms: DataFrame, found: DataFrame) -> DataFrame:
    """``term, candidates``: the names found for each distinct term, best first, or the term itself. ``found``: term, rank, name."""
    names = F.array_sort(F.collect_list(F.struct("rank", "name")))
    own = found.groupBy("term").agg(F.transform(names, lambda x: x["name"]).alias("names"))
    return terms.select("term").distinct().join(own, "term", "left").select("term", F.coalesce("names", F.array("term")).alias("candidates"))
