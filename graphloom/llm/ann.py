"""Approximate nearest neighbours: multiprobe p-stable hashing.

Largest inner product becomes least Euclidean distance by one more component,
sqrt(M^2 - |x|^2) for data (M the largest norm) and 0 for queries. Each of
``TABLES`` hash tables keys a vector by floor((a_i . x + b_i) / width) over n
Gaussian directions a_i, made orthogonal. A bucket's estimated failure for a
query is the sum of squared distances from the query's places along the
directions to the bucket's borders there (0 for its own bucket); a query
probes perturbed buckets in that order, up to a bound that the fit sets.
Candidates of all tables are merged and ranked by exact inner products.

Directions, width and bound are fitted on a bounded sample: the fewest
directions whose probed buckets reach ``RECALL`` and hold at most ``SHARE`` of
the rows. If no number of directions up to the dimension does, as where
vectors point everywhere, the one that reads least is taken. Every row is
indexed. Queries that found fewer than k candidates are searched once more
without a bound.

Scale: the first directions of a table deal its rows into cells of about
``CELL`` rows; queries go only to the cells that the bound reaches, found
direction by direction, without a list of cells. In a cell, blocks of
``BLOCK`` rows meet blocks of ``ASKED`` queries, so a large cell is many
tasks of bounded size; each gives the best k of a query, never pairs. Equal
vectors are one row, which keeps its least ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import NULL_ID, materialize, null_id_back
from graphloom.llm.vectors import classes, matrix, packed, sampled, smallest

K = 20
TABLES = 2
#: Rows and queries that the hash is fitted on, about, the recall asked for there, and the share of rows that may be read.
SAMPLE, SAMPLE_QUERIES, RECALL, SHARE = 8192, 128, 0.95, 0.15
#: Bucket widths that are tried, in standard deviations of places.
WIDTHS = (1.0, 1.5, 2.0)
#: Numbers of directions that are tried: multiples of this, up to the dimension.
STEP = 4
#: Rows of a cell, of a block of data and of a block of queries, about.
CELL, BLOCK, ASKED = 65_536, 8_192, 4_096
#: Queries of a merge task, about.
MERGED = 2_000


@dataclass
class Hash:
    """Directions (tables, n, dim + 1), offsets, width, the largest norm, the bound of a probed bucket's estimated failure, directions that deal rows into cells, and recall and share on the sample."""

    a: np.ndarray
    b: np.ndarray
    width: float
    norm: float
    bound: float
    outer: int = 0
    recall: float = 0.0
    share: float = 0.0

    def places(self, x: np.ndarray, t: int, query: bool) -> np.ndarray:
        """(rows, n) places along the directions of a table, in widths."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return ((np.column_stack([x, last]) @ self.a[t].T) / self.width + self.b[t]).astype(np.float32)

    def cells(self, places: np.ndarray, t: int, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, cells as rows of floors) that the queries' probes reach, direction by direction."""
        for first in range(0, len(places), 64):
            some = places[first : first + 64]
            who, cost, at = np.arange(len(some)), np.zeros(len(some)), np.empty((len(some), 0), np.int16)
            for i in range(self.outer):
                far = self.norm * float(np.linalg.norm(self.a[t, i])) / self.width  # no row lies further out
                cell = np.arange(np.floor(self.b[t, i] - far), np.floor(self.b[t, i] + far) + 1)
                total = cost[:, None] + apart(some[:, i], cell)[who]
                keep, which = np.nonzero(total <= bound)
                who, cost, at = who[keep], total[keep, which], np.column_stack([at[keep], cell[which].astype(np.int16)])
            yield who + first, at


def apart(place: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Squared distances from places to the borders of cells, 0 inside."""
    return np.maximum(0, np.maximum(cell[None, :] - place[:, None], place[:, None] - cell[None, :] - 1)).astype(np.float32) ** 2


def failures(asked: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Estimated failure of each bucket (rows of ``floors``) for each query (rows of places)."""
    costs, inside = [], []
    for i in range(floors.shape[1]):
        cell = np.arange(int(floors[:, i].min()), int(floors[:, i].max()) + 1)
        costs.append(apart(asked[:, i], cell))
        inside.append((floors[:, i : i + 1] == cell[None, :]).astype(np.float32))
    return np.concatenate(costs, axis=1) @ np.concatenate(inside, axis=1).T  # sums, as one matrix product


def directions(rng: np.random.Generator, tables: int, n: int, dim: int) -> np.ndarray:
    """Gaussian directions of length sqrt(dim), orthogonal in groups of up to ``dim``."""
    out = []
    for _ in range(tables):
        own: list[np.ndarray] = []
        while sum(map(len, own)) < n:
            own.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T * np.sqrt(dim))
        out.append(np.concatenate(own)[:n])
    return np.array(out)


def fit(sample: np.ndarray, total: int, norm: float, k: int = K, tables: int = TABLES, recall: float = RECALL, share: float = SHARE, seed: int = 5) -> Hash:
    """The hash with fewest directions that reaches the recall on the sample and reads at most ``share`` of it, or the one that reads least."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    chosen = rng.permutation(len(sample))[:SAMPLE_QUERIES]
    queries = sample[chosen]
    score = queries @ sample.T
    score[np.arange(len(chosen)), chosen] = -np.inf  # a query isn't its own neighbour
    # as many as the k nearest of all rows have among the sample
    near = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(len(sample) - 1, max(3, -(-k * len(sample) // max(total, 1)))))]
    a = directions(rng, tables, dim, dim)
    best, rank = None, None
    for width in WIDTHS:
        h = Hash(a, rng.uniform(0, 1, (tables, dim)), 1.0, norm, np.inf)
        h.width = width * max(1e-12, float(np.concatenate([h.places(sample, t, False) - h.b[t] for t in range(tables)]).std()))
        data, asked = [np.floor(h.places(sample, t, False)).astype(np.int16) for t in range(tables)], [h.places(queries, t, True) for t in range(tables)]
        cost = [np.zeros((len(queries), len(sample)), np.float32) for _ in range(tables)]
        done = 0
        for n in [*range(STEP, dim, STEP), dim]:
            for t in range(tables):
                cost[t] += failures(asked[t][:, done:n], data[t][:, done:n])
            done = n
            least = np.minimum.reduce(cost)
            own = np.take_along_axis(least, near, axis=1)
            bound = float(np.quantile(own, recall, method="higher")) * (1 + 1e-6)
            read = float((least <= bound).mean())
            worth = (0, n, read) if read <= share else (1, read, n)
            if rank is None or worth < rank:
                rank = worth
                best = Hash(a[:, :n], h.b[:, :n], h.width, norm, bound, 0, float((own <= bound).mean()), read)
            if read <= share:
                break
    best.outer = _outer(best, sample, total)
    return best


def _outer(h: Hash, sample: np.ndarray, total: int) -> int:
    """How many directions deal ``total`` rows into cells of about :data:`CELL`."""
    floors = np.floor(h.places(sample, 0, False)).astype(np.int16)
    cells, n = 1.0, 0
    while n < floors.shape[1] and total / cells > CELL:
        p = np.unique(floors[:, n], return_counts=True)[1] / len(floors)
        cells, n = cells / float((p * p).sum()), n + 1
    return n


def _dealt(own: DataFrame, h: Hash, dim: int, query: bool, bound: float) -> DataFrame:
    """``t, cell, node, least, vec``: rows in their cells, or queries in the cells that they reach."""
    held = own.sparkSession.sparkContext.broadcast(h)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            for t in range(len(h.a)):
                places = h.places(x, t, query)
                if query:
                    parts = h.cells(places, t, bound)
                else:
                    parts = [(np.arange(len(x)), np.floor(places[:, : h.outer]).astype(np.int16))]
                for who, at in parts:
                    cell = pa.array([r.tobytes() for r in at], pa.binary())
                    take = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), t, np.int32)), cell, *[batch.column(c).take(take) for c in ("node", "least", "vec")]], ["t", "cell", "node", "least", "vec"])

    return own.select("node", "least", "vec").mapInArrow(rows, "t int, cell binary, node long, least long, vec binary")


def _meet(data: DataFrame, asked: DataFrame, h: Hash, dim: int, k: int, bound: float, block: int, asked_block: int) -> DataFrame:
    """``node, found``: for each query and block of a cell the best k candidates (node, score, least id), packed."""
    held = data.sparkSession.sparkContext.broadcast(h)
    n_data = data.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_data"))
    n_asked = asked.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / asked_block).alias("n_asked"))
    sizes = materialize(n_data.join(n_asked, ["t", "cell"]))  # a row per cell of CELL rows, about

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(sizes, ["t", "cell"])
        rows = rows.withColumn(own[2:], F.pmod(F.xxhash64("node"), F.col(own)))
        return rows.withColumn(other[2:], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("n_data", "n_asked")

    by = ["t", "cell", "data", "asked"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
        h, t = held.value, left.column("t")[0].as_py()
        x, least, node = matrix(left.column("vec"), dim), left.column("least").to_numpy(), left.column("node").to_numpy()
        q = matrix(right.column("vec"), dim)
        floors, bucket = np.unique(np.floor(h.places(x, t, False)).astype(np.int16), axis=0, return_inverse=True)
        order = np.argsort(bucket.ravel(), kind="stable")  # rows of a bucket lie together
        x, least, node, bucket = x[order], least[order], node[order], bucket.ravel()[order]
        low, asked = x.astype(np.float32), h.places(q, t, True)
        near = 1e-5 * float(np.linalg.norm(x, axis=1).max())
        out = []
        for a in range(0, len(q), 256):
            probed = (failures(asked[a : a + 256], floors) <= bound)[:, bucket]
            for i, own in enumerate(probed):
                at = np.flatnonzero(own)
                v = q[a + i]
                if len(at) > k:
                    s = low[at] @ v.astype(np.float32)
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    at = at[s >= edge - near * float(np.linalg.norm(v))]  # of these the exact scores decide
                exact = (x[at] * v).sum(axis=1)  # in the same order for every candidate
                top = np.lexsort((least[at], -exact))[:k]
                out.append(np.rec.fromarrays([node[at[top]], exact[top], least[at[top]]], names="node,score,least").tobytes())
        return pa.table({"node": right.column("node"), "found": pa.array(out, pa.binary())})

    left, right = spread(data, "n_data", "n_asked"), spread(asked, "n_asked", "n_data")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "node long, found binary")


def _merged(found: DataFrame, k: int, groups: int) -> DataFrame:
    """``node, near``: the best k of all candidates of each query, best first, as an array of (node, score)."""

    def merge(table: pa.Table) -> pa.Table:
        who = table.column("node").to_numpy()
        order = np.argsort(who, kind="stable")
        parts = table.column("found").to_pylist()
        nodes, near = [], []
        for own in np.split(order, np.flatnonzero(np.diff(who[order])) + 1):
            got = np.frombuffer(b"".join(parts[i] for i in own), np.dtype([("node", "<i8"), ("score", "<f8"), ("least", "<i8")]))
            got = got[np.unique(got["node"], return_index=True)[1]]
            got = got[np.lexsort((got["least"], -got["score"]))[:k]]
            nodes.append(int(who[own[0]]))
            near.append([{"node": int(r["node"]), "score": float(r["score"])} for r in got])
        return pa.table({"node": pa.array(nodes, pa.int64()), "near": pa.array(near, pa.list_(pa.struct([("node", pa.int64()), ("score", pa.float64())])))})

    return found.withColumn("g", F.pmod(F.xxhash64("node"), F.lit(groups))).groupBy("g").applyInArrow(merge, "node long, near array<struct<node:bigint,score:double>>")


def search(vectors: DataFrame, query: str = "key % 20 = 0", k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, asked_block: int = ASKED, recall: float = RECALL, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``query`` (SQL over ``key``, its id) picks the k other rows found of largest inner product.

    Ties go to the smaller id. Vectors that are null, empty or zero, or hold
    a null or non-finite component, take no part, and vectors of different
    lengths do not meet. A null id is the least id; it comes back as null,
    and is no query. Rows that repeat, or share an id or a vector, are rows
    of their own: each is a candidate of all others, and each that ``query``
    picks has its own ranks. If there are k candidates or fewer, all are
    found. Other columns have no effect. An empty table gives no rows.
    """
    rows = packed(vectors, id_col, vector_col)
    own = classes(rows)
    of = materialize(rows.where(F.col("vec").isNotNull()).select("key", "tag").join(own.select("node", "tag"), "tag").select("key", "node"))
    asked = of.where(F.expr(query) & (F.col("key") > F.lit(NULL_ID)))
    lengths = sorted(own.groupBy("dim").agg(F.count(F.lit(1)).alias("total"), F.max("norm").alias("norm"), F.max("n").alias("n")).collect())  # a row per length of vectors
    # only classes of more rows than a query can name need rounds
    ids = smallest(of, k + 1) if any(r["n"] > k + 1 for r in lengths) else of.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    found = None
    for r in lengths:
        part = _search(own.where(F.col("dim") == r["dim"]), asked.select("node").distinct(), r["dim"], r["total"], r["norm"], k + 1, block, asked_block, recall, share)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return of.select(F.col("key").alias("query_id"), F.lit(0).alias("rank"), F.col("key").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    each = found.select("node", F.explode("near").alias("c")).select("node", F.col("c.node").alias("at"), "c.score")
    each = each.join(ids.select(F.col("node").alias("at"), "keys"), "at")
    item = F.transform("keys", lambda key: F.struct((-F.col("score")).alias("minus"), key.alias("key"), F.col("at")))
    lists = each.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list(item))), 1, k + 1).alias("near"))
    out = asked.join(lists, "node")
    itself = F.array_position(F.transform("near", lambda c: (c["key"] == F.col("key")) & (c["at"] == F.col("node"))), F.lit(True)) - 1
    out = out.withColumn("itself", itself).withColumn("near", F.slice(F.filter("near", lambda c, i: i != F.col("itself")), 1, k))
    out = out.select("key", F.posexplode("near").alias("pos", "c"))
    return out.select(null_id_back("key").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.when(F.col("c.key") != F.lit(NULL_ID), F.col("c.key")).alias("vec_id"), (-F.col("c.minus")).alias("score"))


def _search(own: DataFrame, asked: DataFrame, dim: int, total: int, norm: float, k: int, block: int, asked_block: int, recall: float, share: float) -> DataFrame:
    got = sampled(own, total, SAMPLE).select("vec").toArrow()
    h = fit(matrix(got.column("vec"), dim), total, norm, k - 1, recall=recall, share=share)
    wanted = own.join(asked, "node", "left_semi")
    n_asked = wanted.count()
    groups = max(8, -(-n_asked // MERGED))
    data = _dealt(own, h, dim, False, h.bound)
    found = materialize(_merged(_meet(data, _dealt(wanted, h, dim, True, h.bound), h, dim, k, h.bound, block, asked_block), k, groups))
    if found.agg(F.count(F.when(F.size("near") >= min(k, total), 1))).first()[0] == n_asked:
        return found
    short = materialize(wanted.join(found.where(F.size("near") >= min(k, total)).select("node"), "node", "left_anti").select("node", "least", "vec"))
    everything = float("inf")
    first = data.where(F.col("t") == 0)
    rest = _merged(_meet(first, _dealt(short, h, dim, True, everything).where(F.col("t") == 0), h, dim, k, everything, block, asked_block), k, groups)
    return found.join(short.select("node"), "node", "left_anti").unionByName(rest)
