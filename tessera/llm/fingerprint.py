"""Document fingerprints: threshold-scaled sketches (every shingle hash below a fixed fraction of the hash space).

Sketches of any two documents merge by union, and since membership depends on the hash alone, the share of one
sketch found in another estimates containment however unequal the documents are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batches, cut, shingle_hashes, slices

#: One shingle hash in so many is kept.
SCALE = 8


def sketches(texts: list[str], scale: int = SCALE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text below 2**64 / scale; if none is below, its smallest hash.

    The exception keeps sketches of short texts from being empty and is itself mergeable (see merge). A text
    without words has an empty sketch.
    """
    limit = np.uint64((2**64 - 1) // scale)
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        h, of = shingle_hashes(texts[a:b])
        low = h <= limit
        kept, kept_of = h[low], of[low]
        order = np.lexsort((kept, kept_of))
        kept, kept_of = kept[order], kept_of[order]
        if len(kept):
            new = np.r_[True, (kept[1:] != kept[:-1]) | (kept_of[1:] != kept_of[:-1])]
            kept, kept_of = kept[new], kept_of[new]
        ends = np.searchsorted(kept_of, np.arange(b - a), "right")
        begins = np.r_[0, ends[:-1]]
        words = np.searchsorted(of, np.arange(b - a), "right")
        for k in range(b - a):
            if ends[k] > begins[k]:
                out.append(kept[begins[k] : ends[k]])
            else:
                mine = h[(words[k - 1] if k else 0) : words[k]]
                out.append(mine.min(keepdims=True) if len(mine) else mine)
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of the shingles that two sketches stand for."""
    both = np.union1d(a, b)
    low = both[both <= np.uint64((2**64 - 1) // scale)]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has: 0 to 1. Of texts without words, 1 if both are, else 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    return float((b[np.minimum(at, len(b) - 1)] == a).mean())


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", scale: int = SCALE) -> DataFrame:
    """docs with a column fingerprint (replaced if there is one): the sketch of each text, null counting as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            made = [to_text(s) for s in sketches([t or "" for t in b[text].to_pylist()], scale)]
            cols = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "fingerprint"}
            yield pa.RecordBatch.from_pydict(cols | {"fingerprint": pa.array(made, pa.string())})

    docs = docs.drop("fingerprint")
    return docs.mapInArrow(run, docs.select("*", F.lit("").alias("fingerprint")).schema)


def edited(text: str, other: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_LOWEST = -(2**63)
#: Code points of a text that its place among texts of one id goes by, before a hash of it; rows of a bucket at least.
HEAD, LEAST_ROWS = 32, 64
_PAIR = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(parts: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    """Rows of the result for each own row and the row after it; rows come sorted by bucket, guests last."""
    last: tuple | None = None  # bucket, doc_id, text, sketch
    for b in parts:
        texts = [t or "" for t in b["text"].to_pylist()]
        made = sketches(texts, scale)
        now, pairs = list(zip(b["bucket"].to_pylist(), b["doc_id"].to_pylist(), texts, made, strict=True)), []
        for row, guest in zip(now, b["guest"].to_pylist(), strict=True):
            if last is not None and last[0] == row[0]:
                pairs.append((last, row))
            last = None if guest else row
        changed = [edited(x[2], y[2]) for x, y in pairs]
        for (x, y), e, s in zip(pairs, changed, sketches(changed, scale), strict=True):
            yield x[1], len(x[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_text(x[3]), to_text(s), containment(x[3], s), containment(x[3], y[3])


def _even(spark: SparkSession, n: int) -> list[int]:
    """Numbers that hash partitioning deals to n partitions evenly, one each, in order of the partitions."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < n:
        for r in spark.range(at, at + 16 * n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).collect():
            found.setdefault(r["p"], r["id"])
        at += 16 * n
    return [found[k] for k in range(n)]


def edit_likeness(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's text, and how like they are.

    The next document is the one after it by descending doc_id; after the last comes the first. Null texts count as
    empty, a null doc_id as below all others; rows of equal doc_id follow each other by the first code points of their
    texts, descending, and then by a hash; a single document is its own next. An empty table gives no rows; other columns are
    ignored. Likeness is the containment of the document's sketch in the other. Texts are moved once: to ranges of that
    order of even size, each with the head of the next. A row that is repeated so often that it fills several ranges is dealt
    over them by its place in the input: of equal rows it does not matter which is the last.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.left(text, F.lit(HEAD)).alias("head"), F.xxhash64(text).alias("hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = cut(docs.select(place.alias("place")).groupBy("place").count())
    share = max(LEAST_ROWS, -(-(counted.agg(F.sum("count")).first()[0] or 0) // n))
    # Ranges by their heads, from top to bottom: even ones, and one of its own for each row that fills a range; a row each.
    hot = {tuple(r["place"]): r["count"] for r in counted.where(F.col("count") > share).collect()}
    rest = counted.where(F.col("count") <= share)
    tops = {tuple(r["top"]) for r in rest.repartitionByRange(n, F.desc("place")).groupBy(F.spark_partition_id()).agg(F.max("place").alias("top")).collect()}
    of = lambda p: F.struct(F.lit(p[0]).alias("key"), F.lit(p[1]).alias("head"), F.lit(p[2]).alias("hash"))
    if hot:
        after = counted.agg(*[F.max(F.when(F.col("place") < of(h), F.col("place"))) for h in hot]).first()
        tops |= {tuple(x) for x in after if x is not None} | set(hot)
    if not tops:
        return spark.createDataFrame([], _PAIRS)
    ranges, first = [], 0
    for top in sorted(tops, key=lambda p: (p[0], p[1].encode("utf-8", "surrogatepass"), p[2]), reverse=True):
        ranges.append({"top": dict(zip(("key", "head", "hash"), top, strict=True)), "first": first, "n": -(-hot.get(top, 0) // share) or 1})
        first += ranges[-1]["n"]
    labels = _even(spark, max(n, first))
    table = F.from_json(F.lit(json.dumps(ranges)), "array<struct<top:struct<key:bigint,head:string,hash:bigint>,first:int,n:int>>")
    label = lambda b: F.element_at(F.from_json(F.lit(json.dumps(labels)), "array<int>"), b + 1)
    rows = docs.select(place.alias("place"), "doc_id", text.alias("text"), F.monotonically_increasing_id().alias("at"))
    own = F.element_at(F.filter(table, lambda r: r["top"] >= F.col("place")), F.lit(-1)).alias("own")
    sent = rows.select(own, "place", "doc_id", "text", "at").select(label(F.col("own.first") + F.pmod("at", "own.n").cast("int")).alias("bucket"), F.lit(False).alias("guest"), "place", "doc_id", "text")
    # The head of a range is also, once, a guest of the bucket before it; a repeated row of all buckets of its own but the last.
    keys = sorted({r["top"]["key"] for r in ranges} - {_LOWEST})
    heads = docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin(keys)).select(place.alias("place"), "doc_id", text.alias("text"))
    heads = heads.withColumn("own", F.try_element_at(F.filter(table, lambda r: r["top"] == F.col("place")), F.lit(1))).where("own is not null")
    heads = heads.groupBy("place", "own").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    more = F.when(F.col("own.n") > 1, F.sequence(F.col("own.first"), F.col("own.first") + F.col("own.n") - 2)).otherwise(F.array().cast("array<int>"))
    to = F.concat(F.array(F.pmod(F.col("own.first") - 1, F.lit(first)).cast("int")), more)
    guests = heads.select(F.explode(to).alias("to"), "place", "doc_id", "text").select(label(F.col("to")).alias("bucket"), F.lit(True).alias("guest"), "place", "doc_id", "text")
    dealt = sent.unionByName(guests).repartition(len(labels), "bucket").sortWithinPartitions("bucket", "guest", F.desc("place"))
    return dealt.mapInArrow(lambda parts: batches(_pairs(parts, scale), _PAIR, 1000), _PAIRS)

