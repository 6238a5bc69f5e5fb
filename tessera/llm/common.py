"""Shared pieces: the shared checkpoint folder, hashed word shingles, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir

#: Words of a shingle, and the similarity from which texts are near duplicates.
SHINGLE_WORDS, NEAR = 5, 0.8
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, held in the shared folder so that a lost executor costs no recomputation of what led to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts in order, and the text each is of."""
    enc = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(enc) + b" ", np.uint8)
    ws = _WS[buf]
    starts = np.flatnonzero(ws[:-1] & ~ws[1:]) + 1
    ends = np.flatnonzero(~ws[:-1] & ws[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lens = ends - starts
    firsts = np.cumsum(lens) - lens
    inside = np.flatnonzero(~ws)
    pos = inside - np.repeat(starts, lens)
    v = _BYTE[buf[inside]] * _PLACE[pos & 1023]
    if lens.max() > 1024:
        v = v * ((pos >> 10).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = mix(np.add.reduceat(v, firsts) + lens.astype(np.uint64) * _STEP[0])
    begin = np.cumsum([1] + [len(e) + 1 for e in enc[:-1]])
    return h, np.searchsorted(begin, starts, "right") - 1


def shingle_hashes(texts: list[str], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts in order (not made distinct), and the text each is of.

    A text of fewer words than a shingle has one shingle of all its words; a text without words has none.
    """
    h, of = word_hashes(texts)
    n = len(h)
    if not n:
        return h, of
    counts = np.bincount(of, minlength=len(texts))
    last = np.cumsum(counts)[of]
    i = np.arange(n)
    first = i == last - counts[of]
    keep = (i + words <= last) | (first & (counts[of] < words))
    at = i[keep]
    s = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k < last[at]
        s += np.where(there, h[np.minimum(at + k, n - 1)] + np.uint64(k), np.uint64(7919)) * _STEP[k]
    return mix(s), of[at]


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many characters together; a longer text is alone."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, k
            begin, held = k, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Forest:
    """Disjoint sets over 0..n-1, the smallest member standing for each."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Up to this many links, one task joins them; more are contracted in rounds until as few are left.
FEW_LINKS = 32_768


def _finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = [(x, y) for b in parts for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    ids = sorted({x for e in a for x in e})
    place = {x: k for k, x in enumerate(ids)}
    sets = Forest(len(ids))
    for x, y in a:
        sets.join(place[x], place[y])
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "root": pa.array([ids[sets.root(k)] for k in range(len(ids))], pa.int64())})


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, component): for each id in links (u, v: long), the smallest id reachable.

    Each round, every vertex joins the neighbour (or itself) of the smallest hash and the graph is contracted, so
    the vertices fall by a constant factor; smallest ids travel along, so no step has a component as its key. Once no
    more than `few` links are left (a fixed bound), one task joins those. Every round is cut off in the shared folder.
    """
    e = cut(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    levels: list[DataFrame] = []
    lows: list[DataFrame] = []  # (id, low): the smallest original id of each vertex after that contraction
    while e.count() > few:
        k = len(levels)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        h = lambda c, k=k: F.xxhash64(F.col(c), F.lit(k))
        near = both.groupBy("u").agg(F.min(F.struct(h("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        reps = cut(near.select("u", F.when(h("u") <= F.col("m.h"), F.col("u")).otherwise(F.col("m.v")).alias("r")))
        levels.append(reps)
        was = reps.withColumn("low", F.col("u")) if not lows else reps.join(lows[-1].withColumnRenamed("id", "u"), "u")
        lows.append(cut(was.groupBy(F.col("r").alias("id")).agg(F.min("low").alias("low"))))
        to = e.join(reps.select("u", F.col("r").alias("a")), "u").join(reps.select(F.col("u").alias("v"), F.col("r").alias("b")), "v")
        e = cut(to.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    ends = e.repartition(1).mapInArrow(_finish, "id long, root long")
    if not levels:
        return ends.withColumnRenamed("root", "component")
    tops = cut(ends.join(lows[-1], "id"))
    label = tops.join(tops.groupBy("root").agg(F.min("low").alias("component")), "root").select("id", "component")
    for reps, low in zip(reversed(levels), reversed(lows), strict=True):
        of_rep = low.join(label, "id", "left").select(F.col("id").alias("r"), F.coalesce("component", "low").alias("component"))
        label = cut(reps.join(of_rep, "r").select(F.col("u").alias("id"), "component"))
    return label
