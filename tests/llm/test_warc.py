import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tessera.llm import warc


def plain(rows):
    out = []
    for i, _, t in rows:
        same = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        again = bool(same) and (i is None or i < max(same))
        b = (t or "").encode()
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://x.org/{k % 5}", f"<p>é{k % 7}</p>" * (k % 11)) for k in range(120)]
    rows += [(500, None, None), (None, "http://a b\r\n.c", "only"), (None, "u", "<p>é1</p>"), (501, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (501, "u", "x\r\n\r\ny"), (501, "u", "x\r\n\r\ny"), (502, "v", "x\r\n\r\ny"), (503, "v", "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    for few in (10_000, 0):
        monkeypatch.setattr(warc, "FEW_GROUPS", few)
        got = sorted((tuple(r) for r in warc.captures(df, f"{tmp_path}/w{few}").collect()), key=str)
        assert got == plain(rows)
    records = warc.read(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/w0"))
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}["request"] == len(rows)
    whole = warc.assemble(records).where("response.type = 'response'").collect()
    assert all(r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id for r in whole)
    assert {bytes(r.response.payload).decode() for r in whole} == {t or "" for *_, t in rows}
    assert warc.captures(df.limit(0), f"{tmp_path}/none").count() == 0


def test_large_pages_and_a_repeated_page(spark, tmp_path):
    """Large pages go to archives of few; a page that is written often is a capture each time, and one that copies it refers
    to it by its record's id."""
    rows = [(7, "u", "the same page")] * 3000 + [(k, "v", f"{k} " + "x" * 1_200_000) for k in range(20, 24)] + [(6, "w", "the same page"), (30, "z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.captures(df, f"{tmp_path}/w").collect()), key=str)
    assert got == plain(rows)
    assert {p.name for p in (tmp_path / "w").iterdir() if p.is_dir()} == {"0", "2"}
    records = warc.read(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/w"))
    again = records.where("type = 'revisit'").first()
    assert records.where("type = 'response'").where(records.record_id == again.refers_to).count() == 3000


def test_parse():
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"a\r\n\r\nb", b"\x00\xff"))
    members = b"".join(gzip.compress(x + b"\r\n\r\n") for x in raw.split(b"\r\n\r\nWARC")[:1])
    assert [b for _, b in warc.parse(raw)] == [b for _, b in warc.parse(gzip.compress(raw))] == [b"", b"a\r\n\r\nb", b"\x00\xff"]
    assert len(list(warc.parse(members + members))) == 2
