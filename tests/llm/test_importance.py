import collections
import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from tessera.llm.importance import BUCKETS, bucket_array, resample

SF = "/root/testdata/sf0.001"


def features(text, longest=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % BUCKETS for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def plain(docs, target, longest=1, percent=10, least=20):
    s = collections.Counter(b for _, t in docs for b in features(t, longest)[1])
    t = collections.Counter(b for x in target for b in features(x, longest)[1])
    ss, tt = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        w, own = features(text, longest)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + BUCKETS) / ((s[b] + 1) * (tt + BUCKETS)))) for b in own)
        weight = gain // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def same(spark, docs, target, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, features string, rank int")
    got = resample(d, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, **more)


def test_whole_tables_as_a_loop(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(spark, docs, target)


def test_nulls_empty_texts_long_texts_repeated_rows_and_longer_runs(spark):
    docs = [(None, "lone words here"), (1, None), (2, ""), (3, "Äpfel und ÄPFEL 12 under_score it's"), (4, "same text " * 9), (4, "same text " * 9), (5, "one two three " * 20_000), (6, "...")]
    for longest in (1, 2, 3):
        same(spark, docs, ["same text", None, "apples"], longest=longest, percent=50, least=3)


def test_empty_tables(spark):
    same(spark, [], ["a"])
    same(spark, [(1, "a b"), (2, "c")], [], percent=100, least=1)


def test_buckets_are_made_without_rows_for_features(spark):
    plan = spark.createDataFrame([("a b",)], "text string").select(bucket_array(F.col("text")))
    assert "Generate" not in plan._jdf.queryExecution().toString()
