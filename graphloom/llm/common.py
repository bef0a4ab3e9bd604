"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from graphloom.plans.lineage import materialize

__all__ = ["NULL_ID", "SPANS", "id_or_least", "materialize", "null_id_back", "schema_of", "table", "texts_to_python", "with_text"]

#: Stands for a null id where ids are compared: smaller than any other.
NULL_ID = -(2**63)
#: Documents in a batch that goes to Python, at most.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_to_python(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in batches of at most :data:`TEXT_ROWS` rows from now on in its session.

    The default of 10,000 rows is tens of MB of text, held several times
    over by the JVM and the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if not 0 < now <= TEXT_ROWS:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def with_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``doc`` (a struct of all columns but the text, so that no name can clash) and ``text``, in batches for Python."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return texts_to_python(docs).select(F.struct(*others).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))


def schema_of(rows: DataFrame, *names: str, **more: T.DataType) -> T.StructType:
    """Some fields of a frame and new ones."""
    return T.StructType([*[rows.schema[n] for n in names], *[T.StructField(k, v) for k, v in more.items()]])


#: What a search for spans gives.
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def id_or_least(name: str) -> Column:
    """An id column as long, null as the least value."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def null_id_back(name: str) -> Column:
    """The reverse of :func:`id_or_least`."""
    return F.when(F.col(f"`{name}`") != NULL_ID, F.col(f"`{name}`"))
