"""Corpus pipeline: language, near copies, personal data, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.jaccard import near_copies
from tessera.llm.language import fit, identify
from tessera.llm.packing import pack
from tessera.llm.pii import fresh, redacted
from tessera.sources.shared import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier, learned from their own labels, does not reject. Null and letterless texts are
    rejected; repeated rows stay or go together; no column of docs is changed or lost, whatever its name."""
    (own,) = fresh(docs, "language", "stage_")
    return identify(docs, fit(docs), own).where(~F.col(own + "rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least id, once if it is repeated, or of least text digest if none
    has an id. Rows are told apart by id and text, so different texts of one id are different documents. Blank texts are
    near copies of nothing; of each, one stays for each id, and one without."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    text, key, rank, bare, least, cls, at = fresh(docs, "near", "text", "key", "rank", "bare", "least", "class", "id")
    digest = F.md5(F.coalesce("text", F.lit("")))
    tagged = docs.withColumn(text, digest).withColumn(key, F.concat_ws(":", digest, F.col("doc_id").cast("string")))
    full = F.coalesce("text", F.lit("")).rlike(r"[^\t-\r ]")
    once = Window.partitionBy(key).orderBy("text")
    only = lambda df: df.withColumn(rank, F.row_number().over(once)).where(F.col(rank) == 1).select(own)
    # Each id and text have an id of their own here (below those that near_copies gives to documents without); a text is
    # asked for by that of its least row, and one of its copies, not all, brings it to the comparisons.
    as_id = lambda key: F.shiftright(F.xxhash64(key), 1)
    classes = near_copies(tagged.where(full).select(as_id(key).alias("doc_id"), "text")).groupBy("doc_id").agg(F.min("class_id").alias(cls))
    texts = tagged.where(full).groupBy(text).agg(F.min(F.struct(F.col("doc_id").isNull().alias(bare), "doc_id", text, key)).alias(least))
    texts = texts.join(classes.withColumnRenamed("doc_id", at), as_id(f"{least}.{key}") == F.col(at))
    best = texts.groupBy(cls).agg(F.min(least).alias(least)).select(F.col(f"{least}.{key}").alias(key))
    return only(tagged.where(full).join(best, key, "left_semi")).unionByName(only(tagged.where(~full)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts stay, repeated rows are treated each."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their texts and places in training sequences. Null and empty texts give one row
    without a bin; repeated rows are packed each; columns beside doc_id, text and source play no part."""
    return pack(docs, with_text=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages learn models and pack in sequence; tests hold run() against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sql('select uuid() as u').first()['u']}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
