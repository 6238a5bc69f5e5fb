"""A durable table of what a model said: each text is asked once, and what is there is not asked again."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.sources.shared import held, shared_dir

log = logging.getLogger(__name__)
#: Texts that are asked between two writes, and seconds of the first pause before a call is tried again.
ROUND, BACKOFF = 1024, 0.0
ROWS = "kind string, key string, answer string, error string, run string"


class Answers:
    """Answers under a path, by kind (what is asked of whom) and text.

    Texts are asked in rounds: a round is written before the next is asked, so losing an executor, or cached blocks, asks nothing
    again, and after a crash of the driver only the round that was under way is asked anew. With the same path a later run
    goes on where the one before ended. Failures are kept for the run in which they were made, and asked again by the next.
    Without a path the table is a folder of this run's own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, round_: int = ROUND) -> None:
        self.spark, self.round = spark, round_
        self.run = spark.sql("select uuid() as u").first()["u"]
        self.path = path or f"{shared_dir(spark)}/answers-{self.run}"

    def read(self) -> DataFrame:
        """(kind, key, answer, error) of what was answered, or failed in this run."""
        try:
            own = self.spark.read.schema(ROWS).parquet(self.path)
        except AnalysisException:
            own = self.spark.createDataFrame([], ROWS)
        failed = F.col("error").isNotNull()
        own = own.where(~failed | (F.col("run") == self.run))
        return own.groupBy("kind", "key").agg(F.min_by(F.struct("answer", "error"), F.struct(failed, "run")).alias("a")).select("kind", "key", "a.*")

    def ask(self, rows: DataFrame, text: str, call: Callable[[str], str], kind: str, attempts: int = 1, backoff: float = BACKOFF) -> DataFrame:
        """rows with answer and error (what the last of the attempts failed with; then the answer is null); equal texts are asked once."""
        keyed = held(rows.withColumn("key_", F.sha2(F.concat(F.lit(f"{kind}\n"), F.coalesce(text, F.lit(""))), 256)))

        def one(t: str) -> tuple[str | None, str | None]:
            for k in range(attempts):
                try:
                    return call(t), None
                except Exception as e:  # noqa: BLE001  any failure of the provider is a row, not a failure of the batch
                    error = f"{type(e).__name__}: {e}"
                    if k + 1 < attempts and backoff:
                        time.sleep(backoff * (k + 1))
            return None, error

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                said = [one(t) for t in p["text"]]
                yield p[["key"]].assign(answer=[a for a, _ in said], error=[e for _, e in said])

        todo = keyed.select(F.col("key_").alias("key"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["key"])
        missing = lambda: todo.join(self.read().where(F.col("kind") == kind), "key", "left_anti")
        rounds = -(-missing().count() // self.round)
        for k in range(rounds):
            part = missing().where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
            said = part.repartition(self.spark.sparkContext.defaultParallelism, "key").mapInPandas(run, "key string, answer string, error string")
            said.select(F.lit(kind).alias("kind"), "key", "answer", "error", F.lit(self.run).alias("run")).write.mode("append").parquet(self.path)
        found = self.read().where(F.col("kind") == kind).select(F.col("key").alias("key_"), "answer", "error")
        return held(keyed.join(found, "key_", "left").drop("key_"))
