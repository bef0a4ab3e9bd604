"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are computed where documents are read. Distinct fingerprints
are then joined at Hamming distance ``MOST_BITS`` or less:

* Bits that are correlated are put into the same of m partitions, so that
  skew gathers in few of them.
* If a fingerprint q has thresholds t_i >= -1 on the partitions with
  sum(t_i + 1) = MOST_BITS + 1, any fingerprint within MOST_BITS of q agrees
  with it up to t_i bits on some partition i (else they differ in more than
  MOST_BITS bits). Each q gets the thresholds of least cost, by dynamic
  programming on its estimated candidate counts per partition and radius.
* Every fingerprint is listed under its value on each partition, and under
  the neighbours of that value up to its threshold. Fingerprints listed
  under the same value are candidates; distances are verified.

Estimates come from a bounded sample and steer cost only: any thresholds
with that sum find every link. A value's list is searched breadth first, and
a member is compared only with members not reached yet, so a list of near
copies costs about its length, not its square, and yields a forest of links,
never all pairs. Components then come from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.llm.common import id_or_least, materialize, schema_of, texts_to_python
from graphloom.operators.components import star_forest

BITS = 64
SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Fingerprints that estimates and bit correlations are taken from, at most.
SAMPLE = 512
#: Cost of comparing a candidate, where listing a fingerprint once costs 1.
COMPARE = 0.02
#: Entries of a group of lists that one call gets, about.
GROUP_ROWS = 20_000
#: A value's list is split into blocks of so many entries, which meet pairwise.
LIST_ROWS = 32_768
#: Shingles of a text that are hashed together, at most.
BLOCK_WORDS = 65_536

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes | None) -> int:
    """64 bits by majority over the hashes of a text's word shingles; 0 without words, and a tie of a bit is 0."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return hashed(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, BLOCK_WORDS):
        some = words[a : a + BLOCK_WORDS + SHINGLE - 1]
        m = len(some) - SHINGLE + 1
        h = np.fromiter([hashed(b" ".join(t), SEED) for t in zip(*[some[i:] for i in range(SHINGLE)])], np.uint64, m)
        lanes = _SPREAD[h.view(np.uint8).reshape(m, 8)]  # a byte of counts for each bit
        sums = np.add.reduceat(lanes, np.arange(0, m, 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` (the id, null as the least) and ``fp`` (the fingerprint's bits as a signed long), a row per document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps.view(np.int64))], ["key", "fp"])

    return texts_to_python(docs).select(id_or_least(id_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(rows, "key long, fp long")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of nearly equal width, correlated ones together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0, keepdims=True) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    alike = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(alike, 0)
    free, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        own = [max(free, key=lambda b: (alike[b, sorted(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (alike[b, own].sum(), -b)))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def _masks(parts: list[list[int]]) -> list[np.uint64]:
    return [np.uint64(sum(1 << b for b in own)) for own in parts]


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(fps: np.ndarray, sample: np.ndarray, total: int, parts: list[list[int]], most: int = MOST_BITS, compare: float = COMPARE) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (-1 and up) of each fingerprint on each partition, of least estimated cost, and that cost.

    A threshold's cost is the entries it lists beyond the first, which every
    partition has anyway, and ``compare`` for each estimated candidate.
    """
    n, budget = len(fps), most + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((len(parts), n, budget + 1), np.int8)
    for i, (own, mask) in enumerate(zip(parts, _masks(parts), strict=True)):
        apart = np.bitwise_count((fps & mask)[:, None] ^ (sample & mask)[None, :])
        cost = [np.zeros(n)]
        for r in range(most + 1):
            listed = ball(len(own), r)
            chance = total * listed / 2.0 ** len(own)  # of even values, for what the sample is too small to show
            seen = (apart <= r).sum(axis=1) * (total / max(1, len(sample)))
            cost.append(listed - 1 + compare * (chance + seen))
        now = np.full_like(best, np.inf)
        for spent in range(budget + 1):
            for k in range(spent + 1):  # k: the threshold + 1
                via = best[:, spent - k] + cost[k]
                better = via < now[:, spent]
                now[better, spent] = via[better]
                choice[i, better, spent] = k
        best = now
    left = np.full(n, budget)
    out = np.empty((n, len(parts)), np.int8)
    for i in reversed(range(len(parts))):
        k = choice[i, np.arange(n), left]
        out[:, i] = k - 1
        left -= k
    return out, best[:, budget] + len(parts)


def listed(fps: np.ndarray, thresholds: np.ndarray, parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partition, value and fingerprint of each entry: own values everywhere, neighbours up to the thresholds."""
    part, value, who = [], [], []
    for i, (own, mask) in enumerate(zip(parts, _masks(parts), strict=True)):
        for r in range(max(0, int(thresholds[:, i].max(initial=0))) + 1):
            of = fps if r == 0 else fps[thresholds[:, i] >= r]
            flips = np.array([sum(1 << b for b in c) for c in combinations(own, r)], np.uint64)
            values = ((of & mask)[:, None] ^ flips[None, :]).ravel()
            part.append(np.full(len(values), i, np.int32))
            value.append(values)
            who.append(np.repeat(of, len(flips)))
    return tuple(np.concatenate(x) for x in (part, value, who))


def reach(fps: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For each of distinct fingerprints the index of the first of its component by links among them."""
    out = np.arange(len(fps))
    unseen = np.arange(len(fps))
    while len(unseen):
        first, unseen = unseen[0], unseen[1:]
        queue = [first]
        while queue and len(unseen):
            near = np.bitwise_count(fps[unseen] ^ fps[queue.pop()]) <= most
            if near.any():
                found = unseen[near]
                out[found] = first
                queue += found.tolist()
                unseen = unseen[~near]
    return out


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``u, v``: edges whose components are those of all links among the distinct ``fp`` of a frame."""
    total = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    grouped = [group_bits(sample, m) for m in range(2, 6)]
    parts = min(grouped, key=lambda p: float(allocate(sample, sample, total, p, most)[1].mean()) if len(sample) else 0)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(own), 2048):
                some = own[at : at + 2048]
                part, value, who = listed(some, allocate(some, sample, total, parts, most)[0], parts)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.view(np.int64)), pa.array(who.view(np.int64))], ["part", "value", "fp"])

    lists = materialize(fps.select("fp").mapInArrow(entries, "part int, value long, fp long"))
    sizes = lists.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    n_groups = F.lit(max(64, -(-lists.count() // GROUP_ROWS)))
    lists = lists.withColumn("cell", F.pmod(F.xxhash64("part", "value"), n_groups)).withColumn("pair", F.lit(0).cast("long"))
    long_lists = materialize(sizes.where(F.col("n") > LIST_ROWS).withColumn("blocks", F.ceil(F.col("n") / LIST_ROWS)))
    if long_lists.count():
        lists = lists.join(F.broadcast(long_lists) if long_lists.count() < 10_000 else long_lists, ["part", "value"], "left")
        block, last = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.col("blocks") - 1
        meets = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.least(b, block) * F.col("blocks") + F.greatest(b, block))
        lists = lists.withColumn("pair", F.explode(F.when(F.col("blocks").isNotNull(), meets).otherwise(F.array(F.lit(0).cast("long")))))
        lists = lists.withColumn("cell", F.pmod(F.xxhash64("cell", "pair"), n_groups))

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "value", "pair", "fp"], kind="stable")
        part, value, pair = (rows[c].to_numpy() for c in ("part", "value", "pair"))
        who = rows["fp"].to_numpy(np.int64)
        new = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (value != np.roll(value, 1)) | (pair != np.roll(pair, 1)))
        new = np.unique(np.concatenate(([0], new))) if len(rows) else new
        ends = np.append(new[1:], len(rows))
        u, v = [], []
        for a, b in zip(new[ends - new > 1].tolist(), ends[ends - new > 1].tolist(), strict=True):
            own = who[a:b]
            own = own[np.append(True, own[1:] != own[:-1])]
            root = reach(own.view(np.uint64), most)
            other = root != np.arange(len(own))
            u.append(own[other])
            v.append(own[root[other]])
        return pd.DataFrame({"u": np.concatenate([np.empty(0, np.int64), *u]), "v": np.concatenate([np.empty(0, np.int64), *v])})

    return lists.groupBy("cell").applyInPandas(forest, "u long, v long").distinct()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of all columns), ``key`` and ``fp``, a row per document."""
    given = texts_to_python(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_or_least(id_col).alias("key"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("doc").field(text_col).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(fps.view(np.int64))], ["doc", "key", "fp"])

    return given.mapInArrow(rows, schema_of(given, "doc", "key", fp=T.LongType()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """A row per document: ``key, fp, component`` (the smallest key reachable by links of ``most`` bits or fewer), of :func:`grouped`."""
    return grouped(docs, id_col, text_col, most).drop("root")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """A row per document: ``key, fp, component`` and ``root``, a fingerprint that names the group, also where groups share ids.

    Null and empty texts have the fingerprint 0, which links like any other;
    a null id is the least (:data:`~graphloom.llm.common.NULL_ID`). Rows that
    share an id are documents of their own, each with its text's component.
    An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")))
    forest = star_forest(links(classes, most))
    member = materialize(classes.join(forest.select(F.col("x").alias("fp"), "y"), "fp", "left").select("fp", "least", F.coalesce("y", "fp").alias("root")))
    named = member.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(member.join(named, "root").select("fp", "component", "root"), "fp")
