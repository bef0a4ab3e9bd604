"""Density clusters of vectors, within groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NOISE = -1


def cluster_of(x: np.ndarray, eps: float) -> np.ndarray:
    """Cluster numbers by Euclidean distance at most ``eps`` with two members at least; lone vectors are :data:`NOISE`."""
    n = len(x)
    out = np.full(n, NOISE)
    sq = (x * x).sum(axis=1)
    unseen, number = np.ones(n, bool), 0
    for i in range(n):
        if not unseen[i]:
            continue
        unseen[i] = False
        members, queue = [i], [i]
        while queue:
            k = queue.pop()
            near = np.flatnonzero(unseen & (sq + sq[k] - 2 * x @ x[k] <= eps * eps + 1e-12))
            unseen[near] = False
            members += near.tolist()
            queue += near.tolist()
        if len(members) > 1:
            out[members] = number
            number += 1
    return out


def density_clusters(vectors: DataFrame, eps: float = 0.5, group: str = "id", vector: str = "vector") -> DataFrame:
    """``vectors`` with ``cluster``, numbered within each group in order of ``pos``. A group is one record's descriptions."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        there = rows[vector].notna().to_numpy()
        out = np.full(len(rows), NOISE)
        if there.any():
            out[there] = cluster_of(np.array(rows[vector][there].tolist(), float), eps)
        return rows.assign(cluster=out.astype(np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.groupBy(group).applyInPandas(run, f"{fields}, cluster int")
