"""Sizes of the batches in which rows go to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows, and bytes, in a batch of texts at most; a single longer text is a batch of its own.
TEXT_ROWS = 256
TEXT_BYTES = 4 * 2**20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in batches of at most :data:`TEXT_ROWS` rows and :data:`TEXT_BYTES` from now on in its session.

    A worker holds a batch several times over (as Arrow, as Python strings,
    as prompts and answers), so that Spark's default of 10,000 rows is
    hundreds of MB in each. Rows are none the fewer.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # without a bound, in other units, or larger
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df
