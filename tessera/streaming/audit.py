"""Structured Streaming over an audit log: counts per window. The batch engine has no such operator; this is an extra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "timestamp string, action string, gate_outcome string, verified_count int, unverified_count int, answer_chars int"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events that are appended to a log, with their time as ts."""
    return spark.readStream.schema(EVENTS).json(path).withColumn("ts", F.to_timestamp("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, action, n, unverified) of tumbling windows; later events than the watermark are dropped."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n"), F.coalesce(F.sum("unverified_count"), F.lit(0)).alias("unverified"))
    return own.select(F.col("w.start").alias("start"), "action", "n", "unverified")
