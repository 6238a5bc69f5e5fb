import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, pages, store, vector
from tessera.sources import files
from tessera.streaming.audit import read, windowed


def test_knn_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 20)
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(90, 8)), 2)
    v[50] = v[3]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(200, None)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in vector.knn(df, df.where("vec_id % 9 = 3").withColumnRenamed("vec_id", "query_id"), 5).collect())
    s = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    want = sorted((q, r, int(k)) for q in range(3, 90, 9) for r, k in enumerate(np.lexsort((np.arange(90), -s[q]))[:5], 1))
    assert got == want
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="several lengths"):
        vector.knn(odd, odd.withColumnRenamed("vec_id", "query_id"), 1).collect()


def test_embedding_stand_in(spark):
    got = vector.embed(spark.createDataFrame([("a",), (None,)], "text string")).collect()
    assert len(got[0].embedding) == vector.WIDTH and got[0].embedding[0] == pytest.approx(vector.stand_in("a")[0], abs=1e-6)


def test_store_checks(spark):
    rows = spark.createDataFrame([("", "t", None), ("s", "u", "x")], "source string, text string, title string").withColumn("chunk_ord", F.lit(0))
    assert tuple(store.dropped_keys(rows).first()) == (1, 1)
    assert {r.source for r in store.with_authority(rows, "s").collect()} == {"s"}
    with pytest.raises(ValueError, match="another source"):
        store.with_authority(rows, "other")
    ids = store.with_ids(rows)
    assert store.new_chunks(ids, ids.where("title is null")).select("text").collect()[0].text == "u"


def test_chapter_lines_and_guards(spark, tmp_path):
    own = spark.createDataFrame([("s", 1, "CHAPTER 1\nx"), ("s", 2, "CHAPTER 2a")], "source string, page_number int, text string")
    assert [tuple(r) for r in pages.chapter_census(own).collect()] == [("s", 1, "CHAPTER 1")]
    files.protected(f"{tmp_path}/a", f"{tmp_path}/b")
    for bad in (f"{tmp_path}/b", f"{tmp_path}/b/c", f"{tmp_path}"):
        with pytest.raises(ValueError):
            files.protected(bad, f"{tmp_path}/b")
    files.write_report("whole", f"{tmp_path}/r/x.md")
    assert (tmp_path / "r/x.md").read_text() == "whole" and not list((tmp_path / "r").glob("*.part"))


def test_streamed_audit(spark, tmp_path):
    rows = [(f"2026-01-0{d}T10:0{m}:00.000000+00:00", a) for d, m, a in ((1, 0, "shown"), (1, 1, "shown"), (1, 2, "no_results"), (2, 0, "shown"))]
    spark.createDataFrame(rows, "timestamp string, action string").write.json(f"{tmp_path}/log")
    query = windowed(read(spark, f"{tmp_path}/log"), "1 hour").writeStream.format("memory").queryName("audit_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.action, r.n) for r in spark.table("audit_counts").collect()) == [("no_results", 1), ("shown", 1), ("shown", 2)]
    assert audit.keeps_texts() is False
