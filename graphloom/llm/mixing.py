"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A source takes ``floor(target /
size)`` whole copies of all its documents; what remains of the target is a
sample without replacement. Document i gets a uniform number U_i from a hash
of its id and text and a target inclusion probability p_i; documents are ranked by the
Pareto variable ``odds(U_i) / odds(p_i)``, and the sample is the prefix of
that ranking that fills the remaining words. ``odds(p_i) = odds(f) * g_i``,
where f is the fraction of its source that is still to be taken and ``g_i =
(size_i + 1) / (size_i + 51)`` favours documents of some substance over
fragments. As the odds of f are the same within a source, the ranking needs
only ``v_i = odds(U_i) / g_i``.

Scale: a document is in or out by comparing its (v, id, size) with a cut-off
of its source, so documents are never joined or shuffled by id, and texts
never move. Cut-offs come from word counts summed by (source, range of v),
prefix sums over those ranges, and a running sum inside ranges of about
``RANGE_ROWS`` rows; a source with a third of all documents is many ranges.

Everything is built-in SQL functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.llm.common import id_or_least, materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST_COPIES = 3
#: Documents in one range of the ranking, about.
RANGE_ROWS = 2_000
#: Plans of the sources are broadcast if there are so many at most.
FEW_SOURCES = 100_000
#: The ranking is followed once, and then again among documents that fit in what is left.
FILLS = 4
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (words; 0 for null) and the ranking columns ``v``, ``key`` and ``tie``, the row's place in the input."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.concat(F.lit("mix-"), id_or_least("doc_id").cast("string"), F.lit("-"), F.md5(F.coalesce("text", F.lit(""))))
    bits = F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / F.lit(float(2**52))
    g = (F.col("size") + 1).cast("double") / (F.col("size") + 51).cast("double")
    return docs.withColumn("size", size).withColumn("v", u / (1 - u) / g).withColumn("key", id_or_least("doc_id")).withColumn("tie", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row per source: ``source, source_size, source_rows, target``.

    A source is one row here, so windows over all of them sit in one task,
    which spills. A source is capped if its share by weight of what the sources
    before it, in the order of cap / weight, leave over reaches its cap.
    """
    of = F.array(*[F.lit(w).cast("long") for w in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(of, (nth % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by_ratio = W.orderBy((F.col("cap").cast("double") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total, weight = F.sum("source_size").over(everything), F.sum("w").over(everything)
    per = per.withColumn("left", total - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))).withColumn("left_w", weight - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
    per = per.withColumn("capped", F.col("cap") * F.col("left_w") <= F.col("w") * F.col("left"))
    rest = (total - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).cast("double")
    rest_w = (weight - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0))).cast("double")
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * rest / rest_w))
    return per.select("source", "source_size", "source_rows", "target")


def _cut(rows: DataFrame) -> DataFrame:
    """The last (v, key, size, tie) of each source, in that order, up to which the words stay within ``room``.

    ``rows``: source, n_ranges, room, v, key, size, tie. Returns source, cut,
    words; sources that can take nothing are absent.
    """
    at = F.least((F.col("v") / (1 + F.col("v")) * F.col("n_ranges")).cast("long"), F.col("n_ranges") - 1)
    rows = rows.withColumn("range", F.coalesce(at, F.col("n_ranges") - 1))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), before.alias("before"))
    rows = rows.withColumn("here", F.sum("size").over(W.partitionBy("source", "range").orderBy("v", "key", "size", "tie")))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    rows = rows.withColumn("upto", F.col("before") + F.col("here")).where(F.col("upto") <= F.col("room"))
    return rows.groupBy("source").agg(F.max(F.struct("v", "key", "size", "tie")).alias("cut"), F.max("upto").alias("words"))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, fills: int = FILLS) -> DataFrame:
    """A row per source: targets, ``whole`` copies, and the cut-offs ``cut_k`` with the largest size ``fits_k`` each applies to.

    ``sizes``: source, size, v, key, tie, one row per document.
    """
    per = materialize(targets(sizes, weights, most))
    few = per.count() <= FEW_SOURCES
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    per = per.withColumn("whole", whole).withColumn("room", F.floor(F.col("target") - whole * F.col("source_size")))
    per = per.withColumn("n_ranges", F.ceil(F.col("source_rows") / RANGE_ROWS))
    for k in range(fills):
        per = per.withColumn(f"fits_{k}", F.col("room"))
        rows = _with(sizes, per, few, "n_ranges", "room", *[f"{c}_{i}" for i in range(k) for c in ("cut", "fits")])
        rows = rows.where((F.col("size") <= F.col("room")) & (F.col("size") > 0) & ~_taken(k))
        cuts = _cut(rows).withColumnsRenamed({"source": "s", "cut": f"cut_{k}"})
        per = per.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        per = materialize(per.withColumn("room", F.col("room") - F.coalesce(F.col("words"), F.lit(0))).drop("words"))
    return per


def _with(rows: DataFrame, per: DataFrame, few: bool, *names: str) -> DataFrame:
    """``rows`` with columns of their source, which are broadcast if the sources are few."""
    own = per.select(F.col("source").alias("s"), *[F.col(n) for n in names])
    return rows.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _taken(fills: int) -> Column:
    """Whether one of the first cut-offs takes a row."""
    out = F.lit(False)
    for k in range(fills):
        own = F.struct(F.col("v"), F.col("key"), F.col("size"), F.col("tie"))
        out = out | F.coalesce((F.col("size") <= F.col(f"fits_{k}")) & (own <= F.col(f"cut_{k}")), F.lit(False))
    return out


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) as ``doc`` (a struct of all their columns) with ``size, source_size, target, copies``.

    Null texts and texts without words have size 0 and no copies beyond the
    whole ones. A null source is a source, the last one. Null doc_ids rank as
    the least id. Rows that share an id but not their text have random numbers
    of their own; of rows that share both, as many are taken as there is room
    for, the first in the order of the input's partitions. An empty table
    gives no rows.
    """
    rows = sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source"))
    per = plan(materialize(rows.select("source", "size", "v", "key", "tie")), weights, most)
    return _apply(rows.drop("text"), per)


def _apply(rows: DataFrame, per: DataFrame) -> DataFrame:
    names = [f"{c}_{k}" for k in range(FILLS) for c in ("cut", "fits")]
    rows = _with(rows, per, per.count() <= FEW_SOURCES, "source_size", "target", "whole", *names)
    return rows.withColumn("copies", F.col("whole") + _taken(FILLS).cast("long")).drop("whole", "v", "key", "tie", *names)


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: ``doc_id, source, size, source_size, target, copies, taken``; texts are read once."""
    rows = materialize(sized(docs).select("doc_id", "source", "size", "v", "key", "tie"))
    return _apply(rows, plan(rows.drop("doc_id"))).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the columns of ``docs``."""
    rows = copies(docs).where(F.col("copies") > 0)
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
