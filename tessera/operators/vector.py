"""Exact nearest neighbours by blocks, and a deterministic stand-in for an embedding model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import held, shared_dir

#: Rows of a block of questions and of a block of vectors.
QUERY_BLOCK, VECTOR_BLOCK, WIDTH = 1024, 8192, 384
#: Bytes of questions that are broadcast at a time.
ROUND_BYTES = 64 << 20


def stand_in(text: str, width: int = WIDTH) -> list[float]:
    """A vector made of the text's MD5, for tests and offline use."""
    seed = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return [(seed * (i + 1) % 1000) / 1000 for i in range(width)]


def embed(chunks: DataFrame, text: str = "text", model: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """chunks with an embedding column. model() is called once per worker and gives a function over lists of texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model() if model else lambda texts: [stand_in(t) for t in texts]
        for s in parts:
            yield pd.Series(f(s.fillna("").tolist()))

    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def packed(vectors: DataFrame, name: str, rows: int = VECTOR_BLOCK, by: str | None = None) -> DataFrame:
    """Blocks (by, width, <name>_ids binary, <name>_flat binary) of up to `rows` vectors (id: long, e: array<double>) of one
    length, and of one value of `by`, made where they lie."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            width = pc.list_value_length(b["e"])
            group = b[by] if by else pa.array(np.zeros(b.num_rows, np.int32))
            order = np.lexsort((width.to_numpy(), group.to_numpy()))
            w, g = width.to_numpy()[order], group.to_numpy()[order]
            cuts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])]).tolist() if len(w) else []
            for x, y in zip(cuts, [*cuts[1:], len(w)], strict=True):
                for z in range(x, y, rows):
                    at = pa.array(order[z : min(z + rows, y)])
                    flat = b["e"].take(at).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    row = {by: pa.array([g[x]], pa.int32())} if by else {}
                    yield pa.RecordBatch.from_pydict(row | {"width": pa.array([w[x]], pa.int32()), f"{name}_ids": pa.array([b["id"].take(at).to_numpy().astype("<i8").tobytes()], pa.binary()), f"{name}_flat": pa.array([flat.tobytes()], pa.binary())})

    return vectors.mapInArrow(pack, (f"{by} int, " if by else "") + f"width int, {name}_ids binary, {name}_flat binary")


def best_pairs(pairs: DataFrame, top_k: int, key: str, question_key: str) -> DataFrame:
    """(question_key, key, score): the top_k inner products of each question in each pair of a block of questions and one of vectors."""

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k in range(b.num_rows):
                row = {c: b[c][k].as_py() for c in b.schema.names}
                if row["q_width"] != row["width"]:
                    raise ValueError("embeddings of several lengths cannot be compared")
                ids, vid = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["v_ids"], "<i8")
                qm, vm = (np.frombuffer(row[c], "<f8").reshape(len(n), -1) for c, n in (("q_flat", ids), ("v_flat", vid)))
                out: tuple[list, list, list] = ([], [], [])
                for x in range(0, len(ids), 64):
                    s = np.round(qm[x : x + 64] @ vm.T, 6)
                    for r in range(len(s)):
                        may = np.arange(len(vid)) if len(vid) <= 4 * top_k else np.flatnonzero(s[r] >= np.partition(s[r], len(vid) - top_k)[len(vid) - top_k])
                        own = may[np.lexsort((vid[may], -s[r][may]))[:top_k]]
                        out[0].extend([int(ids[x + r])] * len(own))
                        out[1].extend(vid[own].tolist())
                        out[2].extend(s[r][own].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=[question_key, key, "score"])

    return pairs.mapInArrow(best, f"{question_key} long, {key} long, score double")


def ranked(found: DataFrame, top_k: int, key: str, question_key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(question_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k)


def plain(vectors: DataFrame, key: str) -> DataFrame:
    """(id, e) of vectors (key, embedding) that are there."""
    return vectors.where("embedding is not null").select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))


def in_rounds(asked: DataFrame, rounds: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search() over asked (id and others), which broadcasts what it is given. What needs more than one round is searched when the
    plan is made, one round after the other, so that the driver holds one broadcast at a time; their results are written."""
    if rounds == 1:
        return search(asked)
    spark, found = asked.sparkSession, f"{shared_dir(asked.sparkSession)}/rounds-{asked.sparkSession.sql('select uuid() as u').first()['u']}"
    asked = held(asked)
    for r in range(rounds):
        search(asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)).write.parquet(f"{found}/round={r}")
    return spark.read.parquet(found).drop("round")


def against_all(blocks: DataFrame, questions: DataFrame, top_k: int, key: str, question_key: str) -> DataFrame:
    """The top_k of questions (id, e) among all packed blocks of vectors. Questions are counted when the plan is made."""
    m, width = questions.agg(F.count("*"), F.max(F.size("e"))).first()

    def search(part: DataFrame) -> DataFrame:
        asked = packed(part, "q", QUERY_BLOCK).withColumnRenamed("width", "q_width")
        return ranked(best_pairs(blocks.crossJoin(F.broadcast(asked)), top_k, key, question_key), top_k, key, question_key)

    return in_rounds(questions, max(1, -(-m * (width or 1) * 8 // ROUND_BYTES)), search)


def knn(vectors: DataFrame, questions: DataFrame, top_k: int, key: str = "vec_id", question_key: str = "query_id") -> DataFrame:
    """(question_key, key, score, rank): the top_k inner products of each question's embedding; ties go by key.

    Vectors are packed in blocks where they lie and never move: blocks of questions are broadcast to them, as many rounds of a
    bounded number of bytes as the questions need, and each pair of blocks gives its own top_k. Null embeddings are left out;
    those of several lengths are an error. With unit vectors the score is the cosine. Questions are counted when the plan is made,
    and those of more than one round are searched then.
    """
    return against_all(packed(plain(vectors, key), "v"), plain(questions, question_key), top_k, key, question_key)
