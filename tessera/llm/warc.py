"""WARC archives: written by Spark's text writer, read back and assembled to one nested row per capture.

A capture is a transaction of a request, a response (or a revisit of an equal payload) and a metadata record, which
name each other by WARC-Concurrent-To. Payloads may hold anything: records are read by their lengths, never by
separators. Archives lie in the shared folder, gzip-compressed, some thousand captures each.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.sources.shared import shared_dir

#: Captures of an archive of small pages; up to this many groups of equal payloads are broadcast; least bytes of a revisited
#: payload. Bytes of a small page; each further class holds pages up to 16 times as large, and 16 times fewer an archive.
PER_ARCHIVE, FEW_GROUPS, LEAST_BYTES, SMALL, CLASSES = 4096, 10_000, 0, 65_536, 3
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """The upper-case base32 SHA-1 of bytes or text."""
    h = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(h, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that close it; null fields are left out."""
    head = F.concat(*[F.coalesce(F.concat(F.lit(f"{n}: "), v, F.lit("\r\n")), F.lit("")) for n, v in fields])
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write a capture for each row of pages (page_id, url, html) to archives under path.

    Of equal payloads of at least `least` bytes, the one of largest page_id is the response and smaller (and null) ids are
    revisits of it; rows that repeat it are responses too. A null html is an empty payload. Line ends and blanks in a
    url are dropped, a null url leaves the field out.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\x00-\x20]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", F.octet_length("html").cast("long"))
    groups = own.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first_id", "first_url"))
    few = groups.count() <= FEW_GROUPS
    row = own.join(F.broadcast(groups) if few else groups, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("first_id").isNotNull() & F.coalesce(F.col("page_id") < F.col("first_id"), F.lit(True))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    this = _urn("response", F.col("page_id"), F.col("digest"))
    date, text = F.lit(DATE), lambda x: F.lit(x)
    id_field = lambda kind: ("WARC-Record-ID", this if kind == "response" else _urn(kind, F.col("page_id"), F.col("digest")))
    http_type = ("Content-Type", text("application/http;msgtype=response"))
    target = ("WARC-Target-URI", F.col("url"))
    response = _record([("WARC-Type", text("response")), id_field("response"), ("WARC-Date", date), target, ("WARC-Payload-Digest", digest), http_type], F.concat(http, F.col("html")))
    again = _record([("WARC-Type", text("revisit")), id_field("response"), ("WARC-Date", date), target, ("WARC-Payload-Digest", digest), ("WARC-Profile", text("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _urn("response", F.col("first_id"), F.col("digest"))), ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Refers-To-Date", date), http_type], http)
    request = _record([("WARC-Type", text("request")), id_field("request"), ("WARC-Date", date), target, ("WARC-Concurrent-To", this), ("Content-Type", text("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    about = F.coalesce(F.concat(F.lit("sourceId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record([("WARC-Type", text("metadata")), id_field("metadata"), ("WARC-Date", date), target, ("WARC-Concurrent-To", this), ("Content-Type", text("application/warc-fields"))], about)
    value = F.concat_ws("\r\n\r\n", request, F.when(revisit, again).otherwise(response), metadata)
    # Pages of each class of size are written apart, the larger the fewer to an archive.
    size_class = F.least(F.lit(CLASSES), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("size"), F.lit(1)) / SMALL) / 4))).cast("int")
    for k in sorted(r["k"] for r in own.select(size_class.alias("k")).distinct().collect()):  # a few numbers
        out = row.where(size_class == k).select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, PER_ARCHIVE >> 4 * k)).text(f"{path}/{k}")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an archive, compressed or not."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, f.read(int(fields["content-length"]))


_RECORD = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("http", pa.string()), ("payload", pa.binary())])


def _parsed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        for data in b["content"]:
            held: list[tuple] = []
            size = 0
            for fields, block in parse(data.as_py()):
                http, body = None, block
                if fields.get("content-type", "").startswith("application/http"):
                    http, _, body = block.partition(b"\r\n\r\n")
                held.append((*(fields.get(n) for n in ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-payload-digest")), None if http is None else http.decode("utf-8", "replace"), body))
                size += len(block)
                if size > 8_000_000 or len(held) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RECORD, strict=True)], schema=_RECORD)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RECORD, strict=True)], schema=_RECORD)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (a binaryFile DataFrame): type, ids, head of the HTTP message and payload."""
    return archives.select("content").mapInArrow(_parsed, "type string, record_id string, concurrent_to string, target_uri string, refers_to string, digest string, http string, payload binary")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: response (struct of all its columns) and the request and metadata of its transaction, if any.

    Records meet by the response's id and their WARC-Concurrent-To. Response records of one id (a page that was written
    twice) are a capture each and share one request and metadata record, so however many there are, they may be dealt over
    tasks.
    """
    answer = F.col("type").isin("response", "revisit")
    whole = F.struct(*records.columns)
    others = records.where(~answer & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("transaction")).agg(
        F.any_value(F.when(F.col("type") == "request", whole), True).alias("request"),
        F.any_value(F.when(F.col("type") == "metadata", whole), True).alias("metadata"),
    )
    met = records.where(answer).select(whole.alias("response")).join(others, F.col("response.record_id") == F.col("transaction"), "left")
    return met.select("response", "request", "metadata")


def captures(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives, read them and return each capture: page_id, bytes and digest of the full payload,
    record_type and, for revisits, refers_to: the page of the record that WARC-Refers-To names. Digest and bytes of a response
    are those of what was read; a revisit's, which has no payload, are in its record. An empty table gives no rows, and
    repeated rows each one. A page must fit a task's memory, as a row of any table must; archives are bounded by bytes."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{spark.sql('select uuid() as u').first()['u']}"
    write(pages, path)
    records = read(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)) if _written(spark, path) else read(spark.createDataFrame([], "content binary"))
    told = F.regexp_extract("http", r"(?i)content-length: ([0-9]+)", 1)
    plain = records.select(
        "type", "record_id", "concurrent_to", "refers_to",
        F.when(F.col("type") == "response", F.octet_length("payload")).when(F.col("type") == "revisit", told.try_cast("long")).cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "response", base32_sha1(F.col("payload"))).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.when(F.col("type") == "metadata", F.col("payload").cast("string")).alias("about"),
    )
    page = F.regexp_extract(F.col("metadata.about"), r"(?m)^sourceId: (-?[0-9]+)", 1).try_cast("long")
    found = cut(assemble(cut(plain)).select(page.alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.record_id").alias("id"), F.col("response.refers_to").alias("to")))
    asked = found.where("to is not null").select(F.col("to").alias("asked")).distinct()
    targets = cut(found.join(asked, F.col("id") == F.col("asked"), "left_semi").groupBy(F.col("id").alias("asked")).agg(F.max("page_id").alias("refers_to")))
    few = targets.count() <= FEW_GROUPS
    out = found.join(F.broadcast(targets) if few else targets, F.col("to") == F.col("asked"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _written(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
