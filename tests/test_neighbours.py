"""The stored vector index: exact when all lists are probed, close to it when few are, and reading only these."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators import neighbours, vector
from tessera.operators.neighbours import VectorIndex

SF = "/root/testdata/sf0.1"


def table(spark, rows, key="vec_id"):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{key} long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 32))
    v = np.concatenate([m + 0.35 * rng.normal(size=(60, 32)) for m in middle])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_recall_and_share_of_the_vectors_that_is_read(spark, tmp_path, clustered):
    vectors = table(spark, list(enumerate(clustered)))
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex.build(vectors, f"{tmp_path}/i")
    exact = vector.knn(vectors, asked, 10)
    assert sorted(map(tuple, index.search(asked, 10, probes=len(index.centres)).collect())) == sorted(map(tuple, exact.collect()))
    found = pairs(index.search(asked, 10, probes=6))
    assert len(found & pairs(exact)) >= 0.95 * exact.count()
    read = index.probed(asked, "query_id", 6).select("list", "id").join(index.vectors.groupBy("list").count(), "list").groupBy("id").agg(F.sum("count").alias("n")).agg(F.avg("n")).first()[0]
    assert read < len(clustered) / 4
    plan = index.search(asked.limit(1), 10, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list#" in plan and "IN (" in plan  # folders of other lists are not read
    again = VectorIndex(spark, f"{tmp_path}/i")
    assert pairs(again.search(asked, 10, probes=6)) == found


def test_odd_vectors_and_tables(spark, tmp_path):
    rows = [(1, [1, 0]), (2, [0, 1]), (3, None), (4, [0, 0]), (5, [1, 0]), (6, [0.6, 0.8])]
    index = VectorIndex.build(table(spark, rows), f"{tmp_path}/i")
    asked = table(spark, [(10, [1, 0]), (11, None)], "query_id")
    got = [(r["vec_id"], r["score"], r["rank"]) for r in index.search(asked, 3, probes=9).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (5, 1.0, 2), (6, 0.6, 3)]
    gone = spark.createDataFrame([(1,)], "vec_id long")
    assert [r["vec_id"] for r in index.search(asked, 3, probes=9, gone=gone).orderBy("rank").collect()] == [5, 6, 2]
    with pytest.raises(Exception, match="several lengths"):
        index.search(table(spark, [(1, [1, 0, 0])], "query_id"), 3).collect()
    with pytest.raises(ValueError, match="several lengths"):
        VectorIndex.build(table(spark, [(1, [1]), (2, [1, 2])]), f"{tmp_path}/w")
    empty = VectorIndex.build(table(spark, []), f"{tmp_path}/e")
    assert empty.search(asked, 3).count() == 0
    with pytest.raises(AnalysisException):
        VectorIndex(spark, f"{tmp_path}/none")


def test_a_list_of_copies_is_many_files_of_bounded_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    rows = [(k, [1.0, 0.0]) for k in range(3000)] + [(3000 + k, [0.0, 1.0]) for k in range(10)]
    index = VectorIndex.build(table(spark, rows), f"{tmp_path}/i")
    asked = table(spark, [(k, [1.0, 0.1]) for k in range(9)], "query_id")
    assert {r["vec_id"] for r in index.search(asked, 4).collect()} == {0, 1, 2, 3}


def test_questions_are_broadcast_once_a_round(spark, tmp_path, monkeypatch, clustered):
    vectors = table(spark, list(enumerate(clustered)))
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex.build(vectors, f"{tmp_path}/i")
    monkeypatch.setattr(neighbours, "ROUND_BYTES", 8192)
    monkeypatch.setattr(vector, "ROUND_BYTES", 8192)
    for got, want in ((index.search(asked, 10, probes=len(index.centres)), None), (index.search(asked, 10, probes=6), 1), (vector.knn(vectors, asked, 10), None)):
        assert "Broadcast" not in got._jdf.queryExecution().toString()  # no plan holds the broadcasts of all its rounds
        if want is None:
            s = np.round(clustered[::20].astype(np.float32).astype(float) @ clustered.astype(np.float32).astype(float).T, 6)
            best = {(20 * q, int(k)) for q in range(len(s)) for k in np.lexsort((np.arange(len(clustered)), -s[q]))[:10]}
            assert pairs(got) == best
        else:
            assert got.count() == 10 * asked.count()
