"""Best-fit packing of documents into fixed-length training sequences, under conflicts.

Within a shard, pieces are placed by falling size. Open bins are kept in order of what they have left; the search
starts at the first bin that is large enough and steps to the next ones until a bin has no conflict, which is thus
the tightest compatible one; blocks of bins that all conflict are stepped over at once. Bins hold bitmaps: of the duplicate clusters in them (no two documents of a cluster
share a bin) and, in `per_source` levels, of their sources (no more than that many of a source share one).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches, cut

#: Code points of a bin; documents of a source that may share one; code points and rows of a shard; bins of a block.
CAPACITY, PER_SOURCE, SHARD_CHARS, SHARD_ROWS, BLOCK = 8192, 4, 4_000_000, 8_192, 48


class OpenBins:
    """Bins by what they have left, in blocks; a block knows which clusters and full sources all of its bins share, so that
    the search passes by whole blocks of conflicting bins."""

    def __init__(self, clusters: list[int], full: list[int]) -> None:
        self.clusters, self.full = clusters, full
        self.blocks: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []
        self.shared: list[tuple[int, int]] = []

    def take(self, size: int, cluster: int, source: int) -> tuple[int, int] | None:
        """Remove and return (left, bin) of the tightest bin with room for size and neither bit set."""
        clusters, full = self.clusters, self.full
        low = (size, -1)
        for k in range(bisect_left(self.tops, low), len(self.blocks)):
            every, filled = self.shared[k]
            if every & cluster or filled & source:
                continue
            block = self.blocks[k]
            for at in range(bisect_left(block, low), len(block)):
                number = block[at][1]
                if not clusters[number] & cluster and not full[number] & source:
                    found = block.pop(at)
                    self._renew(k)
                    return found
        return None

    def add(self, left: int, number: int) -> None:
        k = min(bisect_left(self.tops, (left, number)), len(self.blocks) - 1)
        if k < 0:
            self.blocks, self.tops, self.shared, k = [[]], [(0, 0)], [(0, 0)], 0
        block = self.blocks[k]
        insort(block, (left, number))
        if len(block) > 2 * BLOCK:
            self.blocks.insert(k + 1, block[BLOCK:])
            self.tops.insert(k + 1, (0, 0))
            self.shared.insert(k + 1, (0, 0))
            del block[BLOCK:]
            self._renew(k + 1)
            self._renew(k)
        elif len(block) == 1:
            self._renew(k)
        else:
            every, filled = self.shared[k]
            self.tops[k], self.shared[k] = block[-1], (every & self.clusters[number], filled & self.full[number])

    def _renew(self, k: int) -> None:
        block = self.blocks[k]
        if not block:
            del self.blocks[k], self.tops[k], self.shared[k]
            return
        every, filled = -1, -1
        for _, number in block:
            every &= self.clusters[number]
            filled &= self.full[number]
        self.tops[k], self.shared[k] = block[-1], (every, filled)


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster); size is 1 to capacity, source and cluster are small numbers.

    A cluster below 0 is that of a document without copies. Items are placed in the order given.
    """
    clusters: list[int] = []
    full: list[int] = []  # the sources that have their most documents in a bin
    sources: list[list[int]] = []
    bins = OpenBins(clusters, full)
    placed = []
    for size, source, cluster in items:
        source_bit = 1 << source
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        found = bins.take(size, cluster_bit, source_bit)
        if found is None:
            found = capacity, len(clusters)
            clusters.append(0)
            full.append(0)
            sources.append([0] * per_source)
        left, number = found
        clusters[number] |= cluster_bit
        levels = sources[number]
        level = next(k for k in range(per_source) if not levels[k] & source_bit)
        levels[level] |= source_bit
        full[number] = levels[-1]
        placed.append((number, capacity - left))
        if left > size:
            bins.add(left - size, number)
    return placed


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])
_DDL = "doc_id long, piece long, start long, end long, bin_id long, bin_offset long"


def _numbers(values: list, only_repeated: bool) -> list[int]:
    """Small numbers for values, -1 for a null or, if so asked, for a value that occurs once."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    number: dict = {}
    return [-1 if v is None or only_repeated and seen[v] == 1 else number.setdefault(v, len(number)) for v in values]


def _shard(shard: int, rows: list[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """Placed pieces of (shard, doc_id, size, source, cluster, text), which come by falling size."""
    source = _numbers([("", r[3]) for r in rows], False)
    cluster = _numbers([r[4] for r in rows], True)
    order = sorted(range(len(rows)), key=lambda k: (-(rows[k][2] % capacity), k))
    rest = [k for k in order if rows[k][2] % capacity]
    place = dict(zip(rest, best_fit(((rows[k][2] % capacity, source[k], cluster[k]) for k in rest), capacity, per_source), strict=True))
    full = 1 + max((b for b, _ in place.values()), default=-1)
    for k, (_, doc_id, size, _, _, text) in enumerate(rows):
        for p in range(-(-size // capacity)):
            a, b = p * capacity, min(size, (p + 1) * capacity)
            if b - a == capacity:
                at, full = (full, 0), full + 1
            else:
                at = place[k]
            yield (doc_id, p, a, b, (shard << 32) + at[0], at[1]) + (() if text is None else (text[a:b],))


def normal(text: Column) -> Column:
    """What exact copies share: lower-case text with white space runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, with_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start and end in the document, bin_id, bin_offset and, if asked, its text.

    Sizes are code points. A longer document than a bin is cut: whole bins by themselves, its rest packed. cluster names
    what must not share a bin; by default copies up to case and white space. Null sources count as one source; null,
    empty and no texts give one row with length 0 and null bin; repeated rows are packed each (as copies, apart); ties
    of size go by doc_id. Other columns play no part; an empty table gives no rows. Shards are dealt by a hash of the row and
    its place, so that they hold a bounded volume even of one row repeated (but for a longer text than a shard, which is as
    one). Each is packed by itself: a bin is the tightest of its shard. A row's place is that in its split of the input, so other
    splits give other bins, of the same rules.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    same = F.xxhash64(normal(text)) if cluster is None else cluster
    base = docs.select("doc_id", F.length(text).cast("long").alias("size"), F.col("source").cast("string").alias("source"), same.alias("cluster"), F.xxhash64("doc_id", text, F.monotonically_increasing_id()).alias("h"), *([text.alias("text")] if with_text else []))
    if not with_text:
        base = cut(base)
    total = base.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    shards = max(1, -(-(total["size"] or 0) // SHARD_CHARS), -(-total["n"] // SHARD_ROWS))
    tasks = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.where("size > 0").withColumn("shard", F.pmod("h", F.lit(shards)))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "h")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in parts for r in zip(*(b[c].to_pylist() for c in ("shard", "doc_id", "size", "source", "cluster")), b["text"].to_pylist() if with_text else [None] * b.num_rows, strict=True))
        made = (x for shard, own in groupby(rows, itemgetter(0)) for x in _shard(shard, list(own), capacity, per_source))
        yield from batches(made, _OUT.append(pa.field("text", pa.string())) if with_text else _OUT)

    packed = dealt.mapInArrow(run, _DDL + (", text string" if with_text else ""))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    empty = base.where("size = 0").select("doc_id", zero.alias("piece"), zero.alias("start"), zero.alias("end"), none.alias("bin_id"), none.alias("bin_offset"), *([F.lit("").alias("text")] if with_text else []))
    return packed.unionByName(empty)
