"""N-gram Jaccard join with Bayesian candidate pruning.

Each distinct text is a set of hashed word shingles with a MinHash signature. Bands of the signature propose groups;
inside a group, signatures are compared a few values at a time, and a pair is dropped as soon as the posterior
probability (uniform prior, binomial matches) that its similarity reaches the threshold falls below the tolerance.
The pairs left are verified exactly on their shingle sets.

Copies are one class throughout. Groups are dealt out in blocks of bounded numbers and volume, so that no task holds more
than two blocks of one, and a task returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NEAR, Forest, batches, components, cut, mix, shingle_hashes, slices

#: Signature values; bands and their rows (a pair at 0.8 shares no band with probability 3e-8); values compared at a
#: time; tolerance of the posterior; members of a block, and shingles, about.
VALUES, BANDS, ROWS, STEP, TOLERANCE, BLOCK, VOLUME = 128, 24, 3, 32, 1e-9, 512, 250_000
#: Classes of documents without id are numbered from here on.
_UNNAMED = 1 << 62
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _SEEDS | np.uint64(1)


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After n = STEP, 2 STEP, ... values, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def signatures(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(sorted distinct shingle hashes, uint32 signature) of each text, None for one without words."""
    for a, b in slices(texts, 300_000):
        h, of = shingle_hashes(texts[a:b])
        ends = np.searchsorted(of, np.arange(b - a), "right")
        begins = np.r_[0, ends[:-1]]
        full = ends > begins
        sig = np.empty((int(full.sum()), VALUES), np.uint32)
        if len(h):
            at = begins[full]
            for k in range(VALUES):
                sig[:, k] = np.minimum.reduceat(((h ^ _SEEDS[k]) * _ODD[k]) >> np.uint64(32), at)
        row = iter(sig)
        for k in range(b - a):
            yield (np.unique(h[begins[k] : ends[k]]), next(row)) if full[k] else None


def bands(sig: np.ndarray) -> np.ndarray:
    """64-bit values of the bands of signatures (rows)."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out + sig[:, r : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(0x51ED27 + r))
    return out.view(np.int64)


def _sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        texts = [t or "" for t in b["text"].to_pylist()]
        made = list(signatures(texts))
        some = [m[1] for m in made if m is not None]
        found = iter(bands(np.stack(some)) if some else [])
        flat = [None if m is None else next(found) for m in made]
        size = [None if m is None else len(m[0]) for m in made]
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "same": b["same"], "bands": pa.array(flat, pa.list_(pa.int64())), "size": pa.array(size, pa.int64())})


def _verified(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i of a, j of b) have exactly that similarity."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(i) <= 2 * (len(a) + len(b)):
        common = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        _, col = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        row = np.repeat(np.arange(len(a) + len(b)), np.r_[size_a, size_b])
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        total = np.zeros((len(a), len(b)), np.float32)
        width = 2048
        for c in range(0, int(col[-1]) + 1, width):
            lo, hi = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(a) + len(b), width), np.float32)
            m[row[lo:hi], col[lo:hi] - c] = 1
            total += m[: len(a)] @ m[len(a) :].T
        common = total[i, j].astype(np.int64)
    return common >= threshold * (size_a[i] + size_b[j] - common) - 1e-9


def _pairs(band: int, a: list[tuple], b: list[tuple] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i of a, j of b, or i < j of a alone) of which `band` is the first common one; rows are (id, weight, signature, shingles)."""
    sig_a = np.stack([x[2] for x in a])
    sig_b = sig_a if b is None else np.stack([x[2] for x in b])
    band_a = bands(sig_a)
    band_b = band_a if b is None else bands(sig_b)
    fresh = band_a[:, band][:, None] == band_b[:, band][None]
    for k in range(band):
        fresh &= band_a[:, k][:, None] != band_b[:, k][None]
    if b is None:
        fresh &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(fresh)
    matches = np.zeros(len(i), np.int64)
    for n, least in enumerate(least_matches(threshold, TOLERANCE)):
        cols = slice(n * STEP, (n + 1) * STEP)
        for x in range(0, len(i), 65_536):
            matches[x : x + 65_536] += (sig_a[i[x : x + 65_536], cols] == sig_b[j[x : x + 65_536], cols]).sum(1)
        kept = matches >= least
        i, j, matches = i[kept], j[kept], matches[kept]
    if not len(i):
        return i, j
    sets_a = [x[3] for x in a]
    ok = _verified(sets_a, sets_a if b is None else [x[3] for x in b], i, j, threshold)
    return i[ok], j[ok]


_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _compare(parts: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple]:
    """For each block pair, (id, links added) and forest links (u, v). Rows come sorted by task."""

    def rows() -> Iterator[tuple]:
        for b in parts:
            yield from zip(*(b[c].to_pylist() for c in ("band", "bucket", "x", "y", "block", "id", "copies", "sig", "set", "h")), strict=True)

    for (band, _, x, y), own in groupby(rows(), lambda r: r[:4]):
        sides: tuple[list, list] = ([], [])
        for _, (r, *_) in groupby(own, lambda r: (r[5], r[9])):  # a repeated row brings its text again
            sides[r[4] != x].append((r[5], r[6], np.frombuffer(r[7], np.uint32), np.frombuffer(r[8], np.uint64)))
        a, b = sides[0], None if x == y else sides[1]
        if not a or b is not None and not b or b is None and len(a) < 2:
            continue
        i, j = _pairs(band, a, b, threshold)
        right = a if b is None else b
        weight_a, weight_b = np.array([r[1] for r in a]), np.array([r[1] for r in right])
        add_a, add_b = np.bincount(i, weight_b[j], len(a)), np.bincount(j, weight_a[i], len(right))
        for side, add in ((a, add_a), (right, add_b)):
            for k in np.flatnonzero(add):
                yield side[k][0], int(add[k]), None, None
        sets = Forest(len(a) + len(right))
        shift = 0 if b is None else len(a)
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if sets.join(p, q + shift):
                yield None, None, a[p][0], right[q][0]


def near_copies(docs: DataFrame, threshold: float = NEAR, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id that links lead to), n_links, kept (it is that document).

    Similarity is the Jaccard index of the sets of five-word shingles (words are runs without ASCII white space; a text of
    fewer words is one shingle). Links join different documents of at least the threshold; equal texts are linked. n_links
    counts all of them, copies included. Null, empty and blank texts link with nothing. Of rows of equal doc_id and text,
    each is a document; links of different texts of one doc_id are counted together. Rows of a null doc_id count in the
    links of others; their class is null unless they link to a document with an id, and a null class is kept. An empty
    table gives no rows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    seen = cut(keyed.mapInArrow(_sketched, "doc_id long, same string, bands array<long>, size long"))
    # A class is a distinct text, numbered by its least document, or above all of them by a hash where that has no id.
    unnamed = F.lit(_UNNAMED) + F.pmod(F.xxhash64("same"), F.lit(1 << 60))
    classes = seen.where("bands is not null").groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.max("size").alias("size"))
    classes = cut(classes.select("same", F.coalesce("id", unnamed).alias("id"), F.xxhash64("same").alias("h"), "copies", "bands", "size"))
    member = classes.select("id", "h", "copies", "size", F.posexplode("bands").alias("band", "bucket"))
    groups = member.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor("h").alias("a"), F.bit_xor(F.xxhash64("h", "id")).alias("b")).where("n > 1")
    # Bands with the same members are one group, kept under the first: that is where its pairs first meet.
    groups = cut(groups.groupBy("n", "a", "b").agg(F.min(F.struct("band", "bucket")).alias("g"), F.max("size").alias("size")).select("g.band", "g.bucket", "n", "size"))
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / VOLUME))).cast("int")
    inside = member.drop("size").join(groups, ["band", "bucket"]).select("band", "bucket", "id", "h", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("h", F.lit(2)), blocks).cast("int").alias("block"))
    inside = cut(inside)
    # A bitmap of bounded size spares most texts that are in no group the way to the join below, which is exact.
    bits = 1 << min(27, max(20, 4 + inside.count().bit_length()))
    word = F.pmod("h", F.lit(bits))
    marks = inside.groupBy((word / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))")).alias("m")).toArrow()  # bounded by the bits
    chart = np.zeros(bits // 64, np.int64)
    chart[marks["w"].to_numpy()] = marks["m"].to_numpy()
    kinds = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("sig", pa.binary()), ("set", pa.binary())])

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at = b["h"].to_numpy(zero_copy_only=False) & (bits - 1)
            b = b.take(pa.array(np.flatnonzero((chart[at >> 6] >> (at & 63)) & 1)))
            made = signatures([t or "" for t in b["text"].to_pylist()])
            yield from batches(((k, h, m[1].tobytes(), m[0].tobytes()) for k, h, m in zip(b["id"].to_pylist(), b["h"].to_pylist(), made, strict=True) if m is not None), kinds, 1000)

    own = keyed.select(F.coalesce("doc_id", unnamed).alias("id"), F.xxhash64("same").alias("h"), "text")
    made = own.mapInArrow(sets, "id long, h long, sig binary, set binary")
    tasks = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "h", "copies")
    dealt = tasks.join(made, ["id", "h"]).repartition(n, "band", "bucket", "x", "y").sortWithinPartitions("band", "bucket", "x", "y", "id", "h")
    found = cut(dealt.mapInArrow(lambda p: batches(_compare(p, threshold), _FOUND), "id long, links long, u long, v long"))
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    lead = components(found.where("u is not null").select("u", "v")).select("id", "component")
    told = classes.select("same", "id", "copies").join(links, "id", "left").join(lead, "id", "left")
    told = cut(told.select("same", F.coalesce("component", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = seen.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("same")).alias("same")).join(told, "same", "left")
    class_id = F.when(F.coalesce("class", F.lit(0)) < _UNNAMED, F.coalesce("class", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("doc_id"), class_id.isNull()).alias("kept"))
