"""The chunk store: content-addressed rows, merged per source, in versioned Parquet folders."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.text import chunk_id
from tessera.operators.neighbours import VectorIndex
from tessera.operators.segments import SegmentedIndex, merge_segments, write_segment
from tessera.sources.shared import held

log = logging.getLogger(__name__)

METADATA = ("title", "document_type", "chapter_number", "chapter_title", "section_number", "parent_section", "heading", "page_start", "page_end")


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col("text")))


def dropped_keys(chunks: DataFrame) -> DataFrame:
    """One row: metadata values that are null (and so not stored), and the chunks that have any."""
    own = [c for c in METADATA if c in chunks.columns]
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in own), F.lit(0))
    return chunks.select(nulls.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dropped"), F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.lit(0)).alias("affected"))


def first_of_each(chunks: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """The first chunk of each id."""
    return chunks.withColumn("n_", F.row_number().over(Window.partitionBy("chunk_id").orderBy(order))).where("n_ = 1").drop("n_")


def new_chunks(chunks: DataFrame, stored: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """What an insert adds: the first chunk of each id that is not stored."""
    return first_of_each(chunks, order).join(stored.select("chunk_id"), "chunk_id", "left_anti")


def with_authority(chunks: DataFrame, source: str) -> DataFrame:
    """chunks whose empty source is filled in; another source is an error."""
    other = chunks.where((F.coalesce("source", F.lit("")) != "") & (F.col("source") != source)).limit(1).count()
    if other:
        raise ValueError(f"chunks of another source than {source!r}")
    return chunks.withColumn("source", F.lit(source))


def diff(desired: DataFrame, stored: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """(source, chunk_id, op): add, update (metadata differs), keep, or delete, for the sources of desired."""
    if desired.where(F.coalesce("source", F.lit("")) == "").limit(1).count():
        raise ValueError("chunks without source")
    meta = F.struct(*[c for c in METADATA if c in desired.columns and c in stored.columns] or [F.lit(1)])
    want = first_of_each(desired, order).select("source", "chunk_id", meta.alias("want"))
    have = stored.join(desired.select("source").distinct(), "source", "left_semi").select("source", "chunk_id", meta.alias("have"))
    op = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "delete").when(F.col("want").eqNullSafe(F.col("have")), "keep").otherwise("update")
    return want.join(have, ["source", "chunk_id"], "full_outer").select("source", "chunk_id", op.alias("op"))


def counts(changes: DataFrame) -> DataFrame:
    """(source, added, updated, deleted)."""
    number = lambda o: F.sum(F.when(F.col("op") == o, 1).otherwise(0)).alias({"add": "added", "update": "updated", "delete": "deleted"}[o])
    return changes.groupBy("source").agg(number("add"), number("update"), number("delete"))


#: Columns that a chunk table has, with nulls where its sources have none.
COLUMNS = {"title": "string", "document_type": "string", "chapter_number": "int", "chapter_title": "string", "section_number": "string", "parent_section": "string", "heading": "string", "page_start": "int", "page_end": "int"}
#: Buckets of sources, and of the chunks of a source, of a new store; segments of the word index that are kept apart.
BUCKETS, SEGMENTS = (16, 16), 6
#: Bits of a chunk's place: the merge that brought it, the part of that, and the row.
PART_BITS, ROW_BITS = 18, 22
MANIFEST = "seq long, split array<int>, buckets array<struct<bucket:int,folder:string>>, segments array<struct<path:string,seq:long,n:long>>"
Embed = Callable[[DataFrame], DataFrame]


@dataclass
class Manifest:
    """What a version consists of: its number, the folder of each bucket, and the index segments, oldest first, with the
    number of the first merge in each and of the chunks that it brought."""

    seq: int = 0
    split: tuple[int, int] = BUCKETS
    buckets: dict[int, str] = field(default_factory=dict)
    segments: list[tuple[str, int, int]] = field(default_factory=list)

    def bucket(self) -> Column:
        own, most = self.split
        return (F.pmod(F.xxhash64("source"), F.lit(own)) * most + F.pmod(F.xxhash64("chunk_id"), F.lit(most))).cast("int")

    def of_source(self, source: str) -> Column:
        """Whether a bucket may hold chunks of a source."""
        own, most = self.split
        return F.floor(F.col("bucket") / most) == F.pmod(F.xxhash64(F.lit(source)), F.lit(own))


def numbered(chunks: DataFrame, seq: int) -> DataFrame:
    """chunks with their places (pos) in the order of source and chunk_ord, after those of all earlier merges."""
    own = chunks.drop("pos").orderBy("source", "chunk_ord", "chunk_id").withColumn("m_", F.monotonically_increasing_id())
    part, row = F.shiftright("m_", 33), F.col("m_").bitwiseAND((1 << 33) - 1)
    fits = (part < 1 << PART_BITS) & (row < 1 << ROW_BITS)
    place = F.lit(seq << PART_BITS + ROW_BITS) + F.shiftleft(part, ROW_BITS) + row
    return own.withColumn("pos", F.when(fits, place).otherwise(F.raise_error(F.lit("a merge of too many chunks")).cast("long"))).drop("m_")


class Store:
    """Versions of a chunk table under one path, each with its word index. A version is whole once the pointer names it, so
    a crash loses nothing.

    Chunks lie in buckets by source and id; a merge writes the buckets that it changes anew, a segment of the word index for
    what it changes, and a manifest of all buckets and segments of the version. Chunks that stay keep their vectors and places.
    """

    def __init__(self, spark: SparkSession, path: str, model: str | None = None) -> None:
        self.spark, self.path, self.model = spark, path, model

    def _latest(self, column: str = "name") -> str | None:
        try:
            return self.spark.read.schema("name string, at long, model string").json(f"{self.path}/versions").agg(F.max_by(column, "at").alias("n")).first()["n"]
        except AnalysisException:
            return None

    def manifest(self) -> Manifest | None:
        name = self._latest()
        if name is None:
            return None
        m = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{name}").first()
        return Manifest(m["seq"], tuple(m["split"]), dict(map(tuple, m["buckets"] or [])), [tuple(s) for s in m["segments"] or []])

    def _chunks(self, folders: Sequence[str]) -> DataFrame | None:
        if not folders:
            return None
        own = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders])
        return own.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in own.columns})

    def read(self, ids: DataFrame | None = None, source: str | None = None, columns: Sequence[str] | None = None) -> DataFrame | None:
        """The chunks, or None if there is no whole version; of some ids (chunk_id), of one source (its buckets only), or some columns only.

        Rows have a place (pos): merges in their order, and within one source and chunk_ord. Metadata columns that no source has are null.
        """
        m = self.manifest()
        if m is None:
            return None
        folders = list(m.buckets.items())
        if source is not None and folders:
            there = self.spark.createDataFrame([(b,) for b, _ in folders], "bucket int").where(m.of_source(source)).collect()
            folders = [(b, f) for b, f in folders if b in {r["bucket"] for r in there}]
        own = self._chunks([f for _, f in folders])
        if own is None:
            own = self.spark.createDataFrame([], "source string, chunk_id string, chunk_ord long, text string, pos long, embedding array<float>, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
        own = own if source is None else own.where(F.col("source") == source)
        own = own if ids is None else own.join(ids.select("chunk_id"), "chunk_id", "left_semi")
        return own if columns is None else own.select(*columns)

    def lexical(self) -> SegmentedIndex | None:
        """The word index of the latest version; None, with a warning, if it has none that can be read."""
        try:
            m = self.manifest()
            return None if m is None else SegmentedIndex(self.spark, [f"{self.path}/{s[0]}" for s in m.segments])
        except Exception as e:  # noqa: BLE001  a missing or broken index leaves the other arm
            log.warning("the word index of %s cannot be read: %s", self._latest(), e)
            return None

    def neighbours(self) -> VectorIndex | None:
        """The vector index beside the latest version, made at the first call; None without a version."""
        name = self._latest()
        if name is None:
            return None
        try:
            return VectorIndex(self.spark, f"{self.path}/lists/{name}")
        except AnalysisException:
            return VectorIndex.build(self.read(columns=["pos", "embedding"]), f"{self.path}/lists/{name}", "pos")

    def check_model(self, model: str) -> bool:
        """Whether the store was made with this embedding model; one that does not say passes, with a warning (False)."""
        made = self._latest("model")
        if made is not None and made != model:
            raise ValueError(f"the store was made with {made}, not {model}")
        if made is None:
            log.warning("the store does not say which model made it")
        return made is not None

    def sync(self, desired: DataFrame, embed: Embed | None = None) -> DataFrame:
        """Merge chunks of some sources; returns the counts. Without changes nothing is written.

        embed gives chunks their vectors and is called for added chunks only: a chunk whose metadata changes keeps its vector.
        """
        desired = first_of_each(with_ids(desired))
        stored, old = self.read(), self.manifest() or Manifest()
        stored = desired.limit(0).withColumn("pos", F.lit(0).cast("long")) if stored is None else stored
        changes = held(diff(desired, stored))
        told = held(counts(changes))
        if not told.where("added + updated + deleted > 0").limit(1).count():
            return told
        op = lambda o: changes.where(F.col("op") == o).select("source", "chunk_id")
        fresh = desired.join(op("add"), ["source", "chunk_id"], "left_semi")
        fresh = fresh if embed is None else held(embed(fresh))  # numbering reads them more than once
        again = desired.join(op("update"), ["source", "chunk_id"], "left_semi")
        if "embedding" in stored.columns and "embedding" not in desired.columns:
            again = again.join(stored.select("source", "chunk_id", "embedding"), ["source", "chunk_id"])
        seq = old.seq + 1
        new = held(numbered(fresh.unionByName(again, allowMissingColumns=True), seq))
        out = changes.where("op in ('update', 'delete')").select("source", "chunk_id")
        self._write(old, seq, stored, new, out, changes)
        return told

    def _write(self, old: Manifest, seq: int, stored: DataFrame, new: DataFrame, out: DataFrame, changes: DataFrame) -> None:
        stamp = self.spark.sql("select unix_micros(current_timestamp()) as at, uuid() as u").first()
        name = f"v{stamp['at']}-{stamp['u'][:8]}"
        touched = [r["b"] for r in changes.where("op <> 'keep'").select(old.bucket().alias("b")).distinct().collect()]  # as many as there are buckets, at most
        kept = self._chunks([old.buckets[b] for b in touched if b in old.buckets])
        rows = new if kept is None else kept.join(out, ["source", "chunk_id"], "left_anti").unionByName(new, allowMissingColumns=True)
        rows.withColumn("bucket", old.bucket()).repartitionByRange("bucket", "pos").sortWithinPartitions("bucket", "pos").write.partitionBy("bucket").parquet(f"{self.path}/chunks/{name}")
        left = {r["bucket"] for r in self.spark.read.parquet(f"{self.path}/chunks/{name}").select("bucket").distinct().collect()} if rows.limit(1).count() else set()
        buckets = {b: f for b, f in old.buckets.items() if b not in touched} | {b: f"chunks/{name}/bucket={b}" for b in left}
        gone = stored.join(out, ["source", "chunk_id"], "left_semi")
        before = [f"{self.path}/{s[0]}" for s in old.segments]
        typed = lambda df: df.select("pos", "text", (F.col("document_type") if "document_type" in df.columns else F.lit(None)).cast("string").alias("document_type"))
        write_segment(self.spark, f"{self.path}/words/{name}", typed(new), typed(gone), before)
        segments = [*old.segments, (f"words/{name}", seq, new.count())]
        while len(segments) > SEGMENTS:
            segments = self._compacted(segments, buckets, f"words/{name}-{len(segments)}", typed)
        row = self.spark.createDataFrame([(seq, list(old.split), sorted(buckets.items()), segments)], MANIFEST)
        row.coalesce(1).write.json(f"{self.path}/manifests/{name}")
        self.spark.range(1).select(F.lit(name).alias("name"), F.lit(stamp["at"]).alias("at"), F.lit(self.model).alias("model")).write.mode("append").json(f"{self.path}/versions")

    def _compacted(self, segments: list[tuple[str, int, int]], buckets: dict[int, str], path: str, typed: Embed) -> list[tuple[str, int, int]]:
        """segments with the youngest that are together no larger than what they are merged with made one: two at least."""
        at, size = len(segments) - 1, segments[-1][2]
        while at > 0 and (at == len(segments) - 1 or segments[at - 1][2] <= size):
            at, size = at - 1, size + segments[at - 1][2]
        chunks = self._chunks(list(buckets.values())).where(F.col("pos") >= segments[at][1] << PART_BITS + ROW_BITS)
        merge_segments(self.spark, f"{self.path}/{path}", [f"{self.path}/{s[0]}" for s in segments[at:]], typed(chunks))
        return [*segments[:at], (path, segments[at][1], size)]

    def clear(self) -> None:
        """Forget all versions; there may be none."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
