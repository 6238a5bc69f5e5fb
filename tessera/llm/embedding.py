"""Near-duplicate embeddings by product quantisation.

Vectors of one label are compared, copies of a vector as one. A coarse quantiser deals unit vectors to inverted lists; the
residual from the list's centroid is coded by a codebook for each subspace. What probes a list travels as its code, a few
bytes, and meets the vectors of that list: asymmetric distances are added up from tables of each vector's subspace
distances. As the error of each code travels along, a pair is passed by only if the triangle inequality rules it out. What is
left asks for its vector, a row for a query and block and never for a pair, and is reranked by exact cosine.

Of two linked vectors in different lists one at least is within half the search radius of the boundary, as the straight
line between them crosses it: so that probing the lists within half the radius misses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Forest, batches, components, cut

#: Least cosine; rows the quantisers are fitted on for each list, and at least (about, by a hash of the id); most lists;
#: subspaces and codes of each.
NEAR, SAMPLE_OF_LIST, SAMPLE, LISTS, SUBSPACES, CODES = 0.93, 8, 8192, 8192, 16, 64
#: Bytes of a sample at most, but for a row a list.
SAMPLE_BYTES = 256 << 20
#: Lists are probed whose boundary is within this share of the search radius, the proven bound. Vectors of a block of a
#: list, and codes of a block of what probes it.
PROBE, BLOCK, PROBING = 0.5, 1024, 16_384
#: More than the error of a squared distance of unit vectors in single precision.
ROUNDING = 2e-5


def _kmeans(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(v, c)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
        c[near[order][at]] = np.add.reduceat(v[order], at) / np.diff(np.r_[at, len(v)])[:, None]
    return c


def _square(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((v**2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)[None], 0)


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(v[x : x + 4096], c).argmin(1) for x in range(0, len(v), 4096)]) if len(v) else np.zeros(0, int)


class Index:
    """Coarse centroids and subspace codebooks."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = _kmeans(sample, lists)
        own = _nearest(sample, self.coarse)
        rest = self.parts(sample - self.coarse[own])
        self.books = [_kmeans(np.ascontiguousarray(p), CODES) for p in rest]

    def parts(self, v: np.ndarray) -> list[np.ndarray]:
        return np.array_split(v, min(SUBSPACES, v.shape[1]), axis=1)

    def encode(self, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals of v, and how far each decoded vector is from its own."""
        rest = self.parts(v - self.coarse[own])
        codes = np.stack([_nearest(p, b) for p, b in zip(rest, self.books, strict=True)], axis=1).astype(np.uint8)
        error = sum(((p - b[codes[:, m]]) ** 2).sum(1) for m, (p, b) in enumerate(zip(rest, self.books, strict=True)))
        return codes, np.sqrt(error)

    def probes(self, v: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which lists each vector probes (rows x lists): its own, and those with a boundary within the radius."""
        d = _square(v, self.coarse)
        cells, at = np.unique(own, return_inverse=True)
        gaps = np.sqrt(_square(self.coarse[cells], self.coarse))  # of the lists at hand only
        across = (d - d[np.arange(len(v)), own][:, None]) / np.maximum(2 * gaps[at], 1e-12)
        out = across <= radius
        out[np.arange(len(v)), own] = True
        return out

    def norms(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The squares of the lengths of what codes stand for."""
        return sum(((c[own] + b[codes[:, m]]) ** 2).sum(1) for m, (c, b) in enumerate(zip(self.parts(self.coarse), self.books, strict=True)))

    def distances(self, v: np.ndarray, own: int | np.ndarray, codes: np.ndarray, kind: type = np.float64) -> np.ndarray:
        """Distances of vectors (rows) to what codes of lists stand for (columns): each vector's products with the centroids
        and with the codes of each subspace are tables, which the codes look up."""
        own = np.broadcast_to(own, len(codes))
        total = (v @ self.coarse.T).T.astype(kind)[own]
        for m, (p, b) in enumerate(zip(self.parts(v), self.books, strict=True)):
            total += (b @ p.T).astype(kind)[codes[:, m]]
        total *= -2
        total += self.norms(own, codes).astype(kind)[:, None]
        total += (v**2).sum(1).astype(kind)
        return np.sqrt(np.maximum(total, 0, out=total), out=total).T


def _units(vectors: list) -> tuple[np.ndarray, list[int]]:
    """Unit vectors, and the rows they are of: without null, zero, odd-sized (see below) and non-finite ones."""
    good, at = [], []
    for k, v in enumerate(vectors):
        if v is None or not len(v) or isinstance(v, list) and None in v:
            continue
        x = np.asarray(v, np.float64)
        n = np.sqrt((x / (m := np.abs(x).max() or 1.0)) @ (x / m)) if np.isfinite(x).all() else 0.0
        if n > 0 and np.isfinite(n):
            good.append(x / m / n)
            at.append(k)
    return (np.stack(good) if good else np.zeros((0, 1))), at


_KEPT = pa.schema([("label", pa.string()), ("cell", pa.int32()), ("dblock", pa.int32()), ("id", pa.int64())])
_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _tasks(parts: Iterator[pa.RecordBatch], columns: tuple[str, ...], key: int) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """(task, what is there, what comes) of rows that are sorted by task; a row that comes has a true `comes`, the first column."""

    def rows() -> Iterator[tuple]:
        for b in parts:
            yield from zip(*(b[c].to_pylist() for c in columns), strict=True)

    for task, own in groupby(rows(), lambda r: r[1 : key + 1]):
        here: list[tuple] = []
        come: list[tuple] = []
        for r in own:
            (come if r[0] else here).append(r[key + 1 :])
        if here and come:
            yield task, here, come


def _screened(parts: Iterator[pa.RecordBatch], index: Index, radius: float) -> Iterator[tuple]:
    """What comes to a block of a list as a code and may link with a vector of it: (label, cell, dblock, id)."""
    for (label, cell, dblock, _), here, come in _tasks(parts, ("comes", "label", "cell", "dblock", "qblock", "own", "id", "code", "error", "v"), 4):
        v = np.stack([np.frombuffer(r[4], np.float64) for r in here])
        own = np.array([r[0] for r in come])
        codes = np.frombuffer(b"".join(r[2] for r in come), np.uint8).reshape(len(come), -1)
        ids, bound = np.array([r[1] for r in come]), np.sqrt((np.array([r[3] for r in come]) + radius) ** 2 + ROUNDING)
        here_ids = np.array([r[1] for r in here])
        for x in range(0, len(come), 2048):
            near = index.distances(v, own[x : x + 2048], codes[x : x + 2048], np.float32) <= bound[None, x : x + 2048]
            for k in np.flatnonzero(own[x : x + 2048] == cell):  # a vector of this list is near itself
                near[:, k] &= here_ids != ids[x + k]
            for k in np.flatnonzero(near.any(axis=0)):
                yield label, cell, dblock, int(ids[x + k])


def _linked_in(parts: Iterator[pa.RecordBatch], index: Index, least: float) -> Iterator[tuple]:
    """Links (id, links added) and forest links (u, v) between the vectors of each block and those that come to it."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    for (_, cell, _, _), here, come in _tasks(parts, ("comes", "label", "cell", "dblock", "qblock", "own", "id", "copies", "v"), 4):
        q_own, q_id, q_n = (np.array([r[k] for r in come]) for k in range(3))
        d_id, d_n = (np.array([r[k] for r in here]) for k in (1, 2))
        qv, dv = (np.stack([np.frombuffer(r[3], np.float64) for r in s]) for s in (come, here))
        back = index.probes(dv, np.full(len(here), cell), PROBE * radius)  # lists that the vectors here probe themselves
        links_q, links_d, sets = np.zeros(len(come), np.int64), np.zeros(len(here), np.int64), Forest(len(come) + len(here))
        for x in range(0, len(come), 256):
            i, j = np.nonzero((qv[x : x + 256] @ dv.T >= least - 1e-9) & (q_id[x : x + 256, None] != d_id[None]))
            i += x
            ok = np.concatenate([np.einsum("ij,ij->i", qv[i[y : y + 50_000]], dv[j[y : y + 50_000]]) for y in range(0, len(i), 50_000)] or [np.zeros(0)]) >= least
            i, j = i[ok], j[ok]
            links_q += np.bincount(i, d_n[j], len(come)).astype(np.int64)
            alone = ~back[j, q_own[i]]  # the vector here won't come to this query's list
            links_d += np.bincount(j[alone], q_n[i[alone]], len(here)).astype(np.int64)
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if sets.join(a, len(come) + b):
                    yield None, None, int(q_id[a]), int(d_id[b])
        for ids, n in ((q_id, links_q), (d_id, links_d)):
            for k in np.flatnonzero(n):
                yield int(ids[k]), int(n[k]), None, None


def _linked(usable: DataFrame, total: int, least: float, block: int, lists: int | None, width: int) -> tuple[DataFrame, DataFrame] | None:
    """The vectors that can link (id, copies) and links (id, links added) and forest links (u, v) among so many vectors (id,
    label, copies, embedding) of one length; None if the sample has no usable one."""
    n = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lists or int(min(LISTS, max(1, round(np.sqrt(total) / 4))))
    size = max(lists, min(max(SAMPLE, SAMPLE_OF_LIST * lists), SAMPLE_BYTES // (8 * width)))
    part = min(1.0, size / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_003)) < part * 1_000_003)
    rows = chosen.select("id", "embedding").toArrow()  # bounded by the sample
    rows = rows if len(rows) else usable.select("id", "embedding").limit(size).toArrow()
    rows = rows.sort_by("id")["embedding"].combine_chunks()
    sample, _ = _units(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)) if not rows.flatten().null_count else _units(rows.to_pylist())
    if not len(sample):
        return None
    index = Index(sample, lists)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("copies", pa.int64()), ("own", pa.int32()), ("probes", pa.list_(pa.int32())), ("code", pa.binary()), ("error", pa.float32()), ("v", pa.binary())])

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            unit, at = _units(b["embedding"].to_pylist())
            rows = list(zip(*(b[c].to_pylist() for c in ("id", "label", "copies")), strict=True))
            for x in range(0, len(at), 2048):
                v = unit[x : x + 2048]
                own = _nearest(v, index.coarse)
                codes, error = index.encode(v, own)
                probes = index.probes(v, own, PROBE * radius)
                yield from batches(((*rows[k], int(o), np.flatnonzero(p).astype(np.int32), c.tobytes(), float(e), u.tobytes()) for k, o, p, c, e, u in zip(at[x : x + 2048], own, probes, codes, error, v, strict=True)), schema)

    points = cut(usable.mapInArrow(coded, "id long, label string, copies long, own int, probes array<int>, code binary, error float, v binary"))
    of = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    blocks = lambda k: F.ceil(F.count("*") / k).cast("int")
    task = ("label", "cell", "dblock", "qblock")

    def met(come: DataFrame, size_q: DataFrame, here: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """Rows of tasks: what comes, and the vectors of a list's block, once for each block of what comes there."""
        there = here.join(size_q, list(by)).withColumn("qblock", every("nq")).drop("nq")
        rows = come.join(size_q, list(by)).withColumn("qblock", of("nq", 1)).drop("nq").withColumn("comes", F.lit(True))
        return rows.unionByName(there.withColumn("comes", F.lit(False)), allowMissingColumns=True).repartition(n, *task).sortWithinPartitions(*task)

    size_d = points.groupBy("label", F.col("own").alias("cell")).agg(blocks(block).alias("nd"))
    here = points.withColumnRenamed("own", "cell").join(size_d, ["label", "cell"]).select("label", "cell", of("nd", 2).alias("dblock"), F.col("cell").alias("own"), "id", "copies", "v")
    probing = points.select("label", "own", "id", "code", "error", F.explode("probes").alias("cell"))
    size_q = probing.groupBy("label", "cell").agg(blocks(PROBING).alias("nq"))
    first = met(probing.join(size_d, ["label", "cell"]).withColumn("dblock", every("nd")).drop("nd"), size_q, here.drop("copies"), ("label", "cell"))
    left = cut(first.mapInArrow(lambda p: batches(_screened(p, index, radius), _KEPT), "label string, cell int, dblock int, id long"))
    size_q = left.groupBy("label", "cell", "dblock").agg(blocks(block).alias("nq"))
    come = left.join(points.select("id", "own", "copies", "v"), "id")
    second = met(come, size_q, here, ("label", "cell", "dblock"))
    return points.select("id", "copies"), cut(second.mapInArrow(lambda p: batches(_linked_in(p, index, least), _FOUND), "id long, links long, u long, v long"))


def near_vectors(vectors: DataFrame, least: float = NEAR, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id that links lead to), kept (it is that vector).

    Vectors of equal labels (compared as text) with a cosine of at least `least`, in double precision, are linked. A null
    label, and a vector that is null, empty, zero or has a null or non-finite component, links with nothing. Vectors of
    each length have an index of their own, and link among themselves. Rows of an equal id, label and vector are one vector, and
    each is returned; different vectors of an id are different ones. Rows of a null id are returned and link with nothing.
    Other columns play no part. An empty table gives no rows.
    """
    key = ("label", "h", "g")  # two hashes, of 128 bits together, stand for a vector
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    base = base.withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit("second"), "embedding")})
    usable = base.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    # A class is a vector of a label with all its copies. Its number follows its least id, which other hashes cannot share.
    nodes = usable.select("vec_id", *key).distinct().groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = cut(nodes.orderBy("first", *key).withColumn("id", F.monotonically_increasing_id()))
    one = usable.groupBy(*key).agg(F.any_value("embedding").alias("embedding")).join(classes, list(key)).select("id", "label", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    one = cut(one)
    width = F.size("embedding")
    totals = one.groupBy(width.alias("w")).count().orderBy("w").collect()
    parts = [x for w, total in totals if (x := _linked(one.where(width == w), total, least, block, lists, w)) is not None]
    none = F.lit(0).cast("long")
    if not parts:
        return base.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    able, found = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("n"))
    lead = components(found.where("u is not null").select("u", "v"))
    told = able.join(links, "id", "left").join(lead, "id", "left").select("id", (F.coalesce("n", none) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    first = classes.select(F.col("id").alias("component"), F.col("first").alias("top"))
    told = told.join(first, "component").join(classes.select("id", *key), "id").select(*key, "n", "top")
    out = base.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label"))).join(told, list(key), "left")
    top = F.coalesce("top", "vec_id")
    return out.select("vec_id", F.coalesce("n", none).alias("n_links"), top.alias("component_id"), F.coalesce(top == F.col("vec_id"), F.lit(False)).alias("kept"))
