"""Embedding near-dedup: an exact metric range join over pivot cells.

Cosine at or above a threshold is a chord of unit vectors of r or less. A
vector lives in the cell of its nearest pivot. If x lives in the cell of p,
y in that of q, and |x - y| <= r, then all of these hold:

* by the triangle inequality, |x - q| <= r + |y - q| <= r + (radius of q's cell);
* likewise |x - q| <= r + |y - q| <= r + |y - p| <= 2 r + |x - p|;
* x.(p - q) <= y.(p - q) + r |p - q| <= r |p - q|, as y is nearer to q.

x reaches the cells whose pivots satisfy them. Neighbouring cells are put
into groups of about ``GROUP`` rows (a cell with more is several groups), and
a task is a pair of groups: a vector goes to its own group's task and, for
each other group with a cell that it reaches, to the task of the two. So it
is copied at most once a group, and only as far as the bounds demand; nothing
but ids, counts and forests of links is written between the steps.

Equal vectors are one row of the join, with their count as weight. A task
yields, for each vector with links, their weight and a forest of links found
breadth first, never the pairs. Products are in single precision; those near
the threshold are taken again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import materialize
from graphloom.llm.vectors import classes, matrix, packed, sampled
from graphloom.operators.components import star_forest

LEAST_COSINE = 0.95
TILE = 2048
#: Pivots: one for so many vectors, and at most about so many (they are broadcast).
CELL, MOST_PIVOTS = 1000, 1024
#: Rows of a group: a quarter of all rows, within these bounds.
LEAST_GROUP, GROUP = 8_192, 65_536
#: Products so near the threshold are taken again in double precision.
NEAR = 1e-4
#: So many at once.
EXACT = 16_384


def forest(mask: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Edges ("r" or "c", row or column, row) that span the components of a bipartite adjacency matrix."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    while len(rows):
        root, rows = rows[0], rows[1:]
        queue = [root]
        while queue:
            r = queue.pop()
            near = mask[r, cols]
            found, cols = cols[near], cols[~near]
            for c in found.tolist():
                yield "c", c, root
                if len(rows):
                    linked = mask[rows, c]
                    more, rows = rows[linked], rows[~linked]
                    for m in more.tolist():
                        yield "r", m, root
                        queue.append(m)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reached(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and which cells it reaches (its own included)."""
    along = x @ pivots.T
    d = np.sqrt(np.maximum(0, 2 - 2 * along))
    home = d.argmin(axis=1)
    at = np.arange(len(x))
    own = d[at, home][:, None]
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    out = (d <= r + radii[None, :] + 1e-9) & (d <= 2 * r + own + 1e-9)
    out &= along[at, home][:, None] - along <= r * between[home] + 1e-9
    out[at, home] = True
    return home, out


def groups_of(pivots: np.ndarray, sizes: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and its number of groups; cells that follow each other, nearest first, share one."""
    first, many = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    left, at, number, room = set(range(1, len(pivots))), 0, -1, 0
    while True:
        if sizes[at] > group:
            many[at] = -(-int(sizes[at]) // group)
            first[at], number, room = number + 1, number + int(many[at]), 0
        else:
            if sizes[at] > room:
                number, room = number + 1, group
            first[at] = max(number, 0)
            room -= int(sizes[at])
        if not left:
            return first, many
        others = np.array(sorted(left))
        at = int(others[(pivots[others] @ pivots[at]).argmax()])
        left.discard(at)


def _tasks(own: DataFrame, dim: int, total: int, least: float, group: int | None) -> DataFrame:
    """``a, b, g, node, n, vec``: each vector, of group g, in the tasks (a, b) of pairs of groups that it must meet."""
    r = math.sqrt(max(0.0, 2 - 2 * least))
    got = sampled(own, total, min(MOST_PIVOTS, max(2, -(-total // CELL)))).select("vec").toArrow()
    pivots = unit(matrix(got.column("vec"), dim)) if got.num_rows else np.eye(1, dim)
    held = own.sparkSession.sparkContext.broadcast(pivots)  # about MOST_PIVOTS vectors at most

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(held.value), np.int64), np.zeros(len(held.value))
        for batch in batches:
            along = unit(matrix(batch.column("vec"), dim)) @ held.value.T
            home = along.argmax(axis=1)
            n += np.bincount(home, minlength=len(n))
            np.maximum.at(far, home, np.sqrt(np.maximum(0, 2 - 2 * along.max(axis=1))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(far)], ["cell", "n", "far"])

    sizes, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in own.select("vec").mapInArrow(homes, "cell long, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():  # a row per pivot
        sizes[row["cell"]], radii[row["cell"]] = row["n"], row["far"]
    first, many = groups_of(pivots, sizes, group or int(np.clip(-(-total // 4), LEAST_GROUP, GROUP)))
    plan = own.sparkSession.sparkContext.broadcast((pivots, radii, first, many))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii, first, many = plan.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                node = part.column("node").to_numpy()
                home, visits = reached(unit(matrix(part.column("vec"), dim)), pivots, radii, r)
                mine = first[home] + node % many[home]
                meets = np.zeros((len(node), int((first + many).max())), bool)
                for cell in range(len(pivots)):
                    meets[visits[:, cell], first[cell] : first[cell] + many[cell]] = True
                meets[np.arange(len(node)), mine] = True
                who, other = np.nonzero(meets)
                for i in range(0, len(who), 32_768):
                    w, o = who[i : i + 32_768], other[i : i + 32_768]
                    g = mine[w]
                    take = pa.array(w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g, o)), pa.array(np.maximum(g, o)), pa.array(g), *[part.column(k).take(take) for k in ("node", "n", "vec")]], ["a", "b", "g", "node", "n", "vec"])

    return own.select("node", "n", "vec").mapInArrow(dealt, "a long, b long, g long, node long, n long, vec binary")


def links(own: DataFrame, dim: int, total: int, least: float = LEAST_COSINE, group: int | None = None) -> DataFrame:
    """``node, n, root`` from each task: weight of the links found there, and a node of the same component (itself for a root)."""

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, n, which = (table.column(c).to_numpy() for c in ("node", "n", "g"))
        x = unit(matrix(table.column("vec"), dim))
        low = x.astype(np.float32)
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        left, right = np.flatnonzero(which == a), np.flatnonzero(which == b)
        found, ends = np.zeros(len(node), np.int64), []
        for i0 in range(0, len(left), TILE):
            rows_ = left[i0 : i0 + TILE]
            for j0 in range(i0 if a == b else 0, len(right), TILE):
                cols_ = right[j0 : j0 + TILE]
                s = low[rows_] @ low[cols_].T
                mask = s >= np.float32(least - NEAR)
                if a == b and i0 == j0:
                    mask &= np.tri(*mask.shape, -1, dtype=bool).T  # each pair once
                r, c = np.nonzero(mask)
                if not len(r):
                    continue
                doubt = np.flatnonzero(s[r, c] < np.float32(least + NEAR))
                parts = np.split(doubt, range(EXACT, len(doubt), EXACT))
                wrong = np.concatenate([d[(x[rows_[r[d]]] * x[cols_[c[d]]]).sum(axis=1) < least] for d in parts])
                mask[r[wrong], c[wrong]] = False
                r, c = np.delete(r, wrong), np.delete(c, wrong)
                np.add.at(found, rows_[r], n[cols_[c]])
                np.add.at(found, cols_[c], n[rows_[r]])
                at, to = np.unique(r), np.unique(c)  # most rows and columns of a tile have no link
                ends += [((rows_[at] if side == "r" else cols_[to])[k], rows_[at[root]]) for side, k, root in forest(mask[np.ix_(at, to)])]
        some = np.flatnonzero(found)
        u = np.array([e[0] for e in ends], np.int64)
        v = np.array([e[1] for e in ends], np.int64)
        nodes = np.concatenate([node[some], node[u]])
        roots = np.concatenate([node[some], node[v]])
        counts = np.concatenate([found[some], np.zeros(len(u), np.int64)])
        return pa.table({"node": nodes, "n": counts, "root": roots})

    return _tasks(own, dim, total, least, group).groupBy("a", "b").applyInArrow(join, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, group: int | None = None) -> DataFrame:
    """``key, n_links, component`` for each row: other vectors at cosine ``least`` or more, and the smallest key reachable.

    Vectors that are null, empty or zero, or hold a null or non-finite
    component, have no links, and vectors of different lengths don't link. A
    null id is the least; rows that share an id are vectors of their own, and
    repeated rows link with each other. Other columns have no effect. An
    empty table gives no rows.
    """
    rows = packed(vectors, id_col, vector_col)
    own = classes(rows)
    found = None
    for dim, total in sorted(own.groupBy("dim").count().collect()):  # a row per length of vectors
        part = materialize(links(own.where(F.col("dim") == dim), dim, total, least, group))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    counts = found.groupBy("node").agg(F.sum("n").alias("linked"))
    tree = star_forest(found.select("node", "root"), "node", "root").select(F.col("x").alias("node"), "y")
    member = materialize(own.select("node", "tag", "n", "least").join(tree, "node", "left").join(counts, "node", "left").withColumn("y", F.coalesce("y", "node")))
    named = member.groupBy("y").agg(F.min("least").alias("component"))
    of = member.join(named, "y").select("tag", "component", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return rows.select("key", "tag").join(of, "tag", "left").select("key", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "key").alias("component"))
