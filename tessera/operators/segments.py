"""A word index that follows its chunk table by segments.

A segment holds what one merge changed: blocks of the new chunks, the keys of chunks that are gone, and differences: of the
numbers of chunks and tokens, of the terms' document frequencies, and of how many terms have each frequency (the mean
idf follows from that). The sums over all segments are the statistics of the chunks that are there, so scores are those of
an index built anew. Keys are places (pos); a block holds 2^BLOCK_BITS places at most, so what is gone finds its block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.lexical import EPSILON, LexicalIndex, write_blocks
from tessera.sources.shared import held

BLOCK_BITS = 11
KEPT = ("document_type",)
_PARTS = {"terms": "term string, df long", "spread": "df long, terms long", "gone": "pos long", "stats": "n long, total long"}


def _read(spark: SparkSession, paths: Sequence[str], part: str) -> DataFrame:
    return spark.read.schema(_PARTS[part]).parquet(*[f"{p}/{part}" for p in paths]) if paths else spark.createDataFrame([], _PARTS[part])


def _counted(chunks: DataFrame, sign: int) -> DataFrame:
    return chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df"))


def _sized(chunks: DataFrame, sign: int) -> DataFrame:
    return chunks.select(F.size(tokens(F.col("text"))).alias("t")).agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("t"), F.lit(0))).alias("total"))


def write_segment(spark: SparkSession, path: str, new: DataFrame, gone: DataFrame, before: Sequence[str]) -> None:
    """The segment of new and gone chunks (pos, text, document_type), after the segments before it."""
    write_blocks(new.orderBy("pos"), f"{path}/blocks", "pos", keep=KEPT, group=F.shiftright("pos", BLOCK_BITS))
    gone.select("pos").write.mode("overwrite").parquet(f"{path}/gone")
    _sized(new, 1).unionByName(_sized(gone, -1)).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{path}/stats")
    _counted(new, 1).unionByName(_counted(gone, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.mode("overwrite").parquet(f"{path}/terms")
    changed = _read(spark, [path], "terms")
    had = _read(spark, before, "terms").join(changed.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("was"))
    both = changed.join(had, "term", "left").select(F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("df")).alias("now"))
    moved = both.select("was", F.lit(-1).alias("terms")).unionAll(both.select("now", F.lit(1))).withColumnRenamed("was", "df").where("df > 0")
    moved.groupBy("df").agg(F.sum("terms").alias("terms")).where("terms <> 0").write.mode("overwrite").parquet(f"{path}/spread")


def merge_segments(spark: SparkSession, path: str, merged: Sequence[str], chunks: DataFrame) -> None:
    """One segment in place of some neighbours; chunks are those that are there of the ones they brought."""
    write_blocks(chunks.orderBy("pos"), f"{path}/blocks", "pos", keep=KEPT, group=F.shiftright("pos", BLOCK_BITS))
    own = spark.read.parquet(*[f"{p}/blocks" for p in merged]).select(F.explode("of_key").alias("pos"))
    _read(spark, merged, "gone").join(own, "pos", "left_anti").write.mode("overwrite").parquet(f"{path}/gone")
    _read(spark, merged, "stats").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{path}/stats")
    for part, key, value in (("terms", "term", "df"), ("spread", "df", "terms")):
        _read(spark, merged, part).groupBy(key).agg(F.sum(value).alias(value)).where(f"{value} <> 0").write.mode("overwrite").parquet(f"{path}/{part}")


class SegmentedIndex(LexicalIndex):
    """The index of segments under their paths, oldest first; a missing part is an AnalysisException."""

    def __init__(self, spark: SparkSession, paths: Sequence[str]) -> None:
        self.spark, self.paths = spark, list(paths)
        own = spark.read.parquet(*[f"{p}/blocks" for p in self.paths])
        gone = _read(spark, self.paths, "gone").groupBy(F.shiftright("pos", BLOCK_BITS).alias("group")).agg(F.collect_list("pos").alias("gone"))
        self.blocks = own.join(gone, "group", "left")
        self.n, total = _read(spark, self.paths, "stats").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        self.avgdl = total / self.n if self.n else 0.0
        spread = _read(spark, self.paths, "spread").groupBy("df").agg(F.sum("terms").alias("terms"))
        self.floor = spread.agg(EPSILON * F.sum(F.col("terms") * self._raw()) / F.sum("terms")).first()[0] or 0.0

    def _raw(self) -> F.Column:
        return F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    def _idf(self, counted: DataFrame) -> DataFrame:
        return counted.where("df > 0").withColumn("idf", F.when(self._raw() < 0, F.lit(self.floor)).otherwise(self._raw()))

    @property
    def terms(self) -> DataFrame:
        return self._idf(_read(self.spark, self.paths, "terms").groupBy("term").agg(F.sum("df").alias("df")))

    def weights(self, asked: DataFrame, few: bool) -> DataFrame:
        wanted = asked.select("term").distinct()
        own = _read(self.spark, self.paths, "terms").join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
        return self._idf(own.groupBy("term").agg(F.sum("df").alias("df"))).select("term", "idf").join(F.broadcast(asked) if few else asked, "term")
