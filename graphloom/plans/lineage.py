"""Materialising a frame so that long or iterative plans stay short."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where a local session
    (as in tests) has none, a temporary one is set. On a cluster a folder of
    one machine would be no shared one, so a session without one is refused.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        set_to = spark.conf.get("spark.checkpoint.dir", None)
        if not set_to and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder, lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
