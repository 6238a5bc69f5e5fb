"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, which only a local session can use."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_dir = spark.conf.get("spark.checkpoint.dir", None)
        if set_dir is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: a lost executor does not make them anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
