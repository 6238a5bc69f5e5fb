"""Approximate nearest neighbours: a stored index of inverted lists, searched by the lists whose centres are nearest.

Centres are fitted on a bounded sample; every vector lies in the list of its nearest centre, a folder of the table, so that a
search reads the folders of the lists that its questions probe and no others. What it finds there has exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.vector import QUERY_BLOCK, against_all, best_pairs, in_rounds, packed, plain, ranked
from tessera.sources.shared import held

#: Lists at most, sampled rows a list, bytes of a sample at most, rounds of the fit.
LISTS, A_LIST, SAMPLE_BYTES, ROUNDS = 4096, 32, 128 << 20, 10
#: Lists that a question probes, and bytes of questions that are broadcast at a time.
PROBES, ROUND_BYTES = 8, 64 << 20


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def centres(v: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centres of unit length of a sample, by spherical k-means; a list that runs empty takes the vector that fits worst."""
    rng = np.random.default_rng(seed)
    v = unit(np.nan_to_num(v.astype(np.float32)))
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(ROUNDS):
        best = [(s.argmax(1), s.max(1)) for s in (v[x : x + 4096] @ c.T for x in range(0, len(v), 4096))]
        of, fit = (np.concatenate(x) for x in zip(*best, strict=True))
        sums = np.zeros_like(c)
        np.add.at(sums, of, v)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        sums[empty] = v[np.argsort(fit)[: len(empty)]]
        c = unit(sums)
    return c


class VectorIndex:
    """An index under a path: centres, and vectors (id, e) in a folder for each list. It is whole once its centres are written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Open an index; a missing or unfinished one is an AnalysisException."""
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow()
        self.centres = np.array(rows["e"].to_pylist(), np.float32)
        self.vectors = spark.read.schema("id long, e array<double>, list int").parquet(f"{path}/lists") if len(self.centres) else spark.createDataFrame([], "id long, e array<double>, list int")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", lists: int | None = None) -> VectorIndex:
        """Index vectors (key, embedding of one length); null embeddings are left out, an empty table gives an empty index.

        The lists are as many as the square root of the rows, LISTS at most; their centres follow from A_LIST sampled rows
        each, by a hash of the key, SAMPLE_BYTES at most in all.
        """
        spark = vectors.sparkSession
        own = vectors.where("embedding is not null").select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
        n, least, width = own.agg(F.count("*"), F.min(F.size("e")), F.max(F.size("e"))).first()
        if least != width:
            raise ValueError("embeddings of several lengths cannot be compared")
        found = np.zeros((0, 0), np.float32)
        if n:
            k = min(LISTS, lists or max(1, int(n**0.5)), n)
            rows = min(n, max(k, min(A_LIST * k, SAMPLE_BYTES // (8 * width))))
            sample = own.select("e", F.xxhash64("id").alias("h")).orderBy("h").limit(rows).select("e").toArrow()
            found = centres(sample["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width), k)
            near = lambda e: found @ np.nan_to_num(e).T

            def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in parts:
                    for x in range(0, b.num_rows, 4096):
                        part = b.slice(x, 4096)
                        e = part["e"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near(e).argmax(0), pa.int32())], names=[*part.schema.names, "list"])

            dealt = own.mapInArrow(place, "id long, e array<double>, list int").repartitionByRange("list", "id")  # a long list is many files
            dealt.sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        rows = [(k, [float(x) for x in c]) for k, c in enumerate(found)]
        spark.createDataFrame(rows, "list int, e array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path)

    def probed(self, questions: DataFrame, question_key: str, probes: int) -> DataFrame:
        """(id, e, list): a row for each question and each of the lists of its nearest centres."""
        found = self.centres

        def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                if not b.num_rows:
                    continue
                e = b["e"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if e.shape[1] != found.shape[1]:
                    raise ValueError("embeddings of several lengths cannot be compared")
                s = np.nan_to_num(e) @ found.T
                k = min(probes, len(found))
                lists = np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()
                at = pa.array(np.repeat(np.arange(b.num_rows), k))
                yield pa.RecordBatch.from_arrays([*[pc.take(c, at) for c in b.columns], pa.array(lists, pa.int32())], names=[*b.schema.names, "list"])

        asked = questions.where("embedding is not null").select(F.col(question_key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
        return asked.mapInArrow(near, "id long, e array<double>, list int")

    def search(self, questions: DataFrame, top_k: int, probes: int = PROBES, key: str = "vec_id", question_key: str = "query_id", gone: DataFrame | None = None) -> DataFrame:
        """(question_key, key, score, rank): of the vectors in the lists that a question probes, the top_k inner products;
        ties go by key. With as many probes as lists that is exact. gone (key) names vectors that are no candidates.

        Which lists are probed at all is found when the plan is made, and only their folders are read; questions of more than
        one round are searched then.
        """
        if not len(self.centres):
            return questions.limit(0).select(F.col(question_key).cast("long").alias(question_key), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        own = self.vectors if gone is None else self.vectors.join(gone.select(F.col(key).alias("id")), "id", "left_anti")
        if probes >= len(self.centres):  # every block meets every question: these go out once, not once for each list
            return against_all(packed(own, "v"), plain(questions, question_key), top_k, key, question_key)
        asked = held(self.probed(questions, question_key, probes))
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # LISTS at most
        blocks = packed(own.where(F.col("list").isin(lists)), "v", by="list")

        def search(part: DataFrame) -> DataFrame:
            near = packed(part.repartition("list"), "q", QUERY_BLOCK, by="list").withColumnRenamed("width", "q_width")
            return ranked(best_pairs(blocks.join(F.broadcast(near), "list"), top_k, key, question_key), top_k, key, question_key)

        return in_rounds(asked, max(1, -(-asked.count() * self.centres.shape[1] * 8 // ROUND_BYTES)), search)
