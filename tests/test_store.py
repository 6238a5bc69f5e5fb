"""The store by changes: what is embedded, written and indexed is what a merge changes."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import store as module
from tessera.operators.lexical import LexicalIndex
from tessera.operators.store import Store

WORDS = "the oil lamp berth signal fog harbour master fee rope chain light tide gate pilot".split()


def text(k):
    return " ".join(WORDS[(k * 7 + j * (k % 5 + 1)) % len(WORDS)] for j in range(4 + k % 9))


def chunks(spark, rows):
    return spark.createDataFrame([(s, t, title, kind, o) for o, (s, t, title, kind) in enumerate(rows)], "source string, text string, title string, document_type string, chunk_ord int")


def counting(spark):
    """An embedder that counts the texts it is given."""
    seen = spark.sparkContext.accumulator(0)

    def embed(df):
        def run(parts):
            for pdf in parts:
                seen.add(len(pdf))
                yield pdf.assign(embedding=[[float(len(t)), 1.0] for t in pdf["text"]])

        return df.mapInPandas(run, df.withColumn("embedding", F.array().cast("array<float>")).schema)

    return embed, seen


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_added_texts_are_embedded_and_vectors_stay(spark, tmp_path):
    s, (embed, seen) = Store(spark, f"{tmp_path}/s"), counting(spark)
    rows = [("a", text(k), "t", "x") for k in range(11)]
    s.sync(chunks(spark, rows), embed)
    assert seen.value == len({t for _, t, _, _ in rows})
    before = {r["chunk_id"]: (r["pos"], list(r["embedding"])) for r in s.read().collect()}
    was = seen.value
    s.sync(chunks(spark, [*rows, ("a", "a new section", "t", "x")]), embed)
    assert seen.value == was + 1
    after = {r["chunk_id"]: (r["pos"], list(r["embedding"])) for r in s.read().collect()}
    assert len(after) == len(before) + 1 and all(after[k] == v for k, v in before.items())
    assert [tuple(r)[1:] for r in s.sync(chunks(spark, [(a, t, "other", x) for a, t, _, x in rows]), embed).collect()] == [(0, len(before), 1)]
    assert seen.value == was + 1  # other metadata embeds nothing
    assert {r["chunk_id"]: list(r["embedding"]) for r in s.read().collect()} == {k: v for k, (_, v) in before.items()}
    assert {r["title"] for r in s.read().collect()} == {"other"}


def test_a_small_merge_writes_little(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    rows = [(f"s{k % 9}", f"{text(k)} {k} " + "filler " * 300, "t", "x") for k in range(600)]
    s.sync(chunks(spark, rows))
    old = files(f"{tmp_path}/s")
    grown = [r for r in rows if r[0] == "s3"] + [("s3", "one more", "t", "x")]
    assert [tuple(r) for r in s.sync(chunks(spark, grown)).collect()] == [("s3", 1, 0, 0)]
    now = files(f"{tmp_path}/s")
    assert all(now[f] == n for f, n in old.items())  # nothing is overwritten
    table = {f: n for f, n in now.items() if f not in old and "/chunks/" in f}
    assert len(table) == 1 and sum(table.values()) < sum(n for f, n in old.items() if "/chunks/" in f) / 10
    assert s.read().count() == 601 and s.read(source="s3").count() == len(grown)
    s.sync(chunks(spark, [("s3", "one more", "t", "x")]))
    assert s.read().count() == 601 - len(grown) + 1


def same_index(spark, s, path):
    """The scores of the segments are those of an index built anew, for all terms and some filter."""
    table = s.read().select("pos", F.col("text"), "document_type")
    whole = LexicalIndex.build(table, path, "pos", keep=("document_type",))
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["the lamp", "fog fog signal", "rope chain tide gate", "absent", " ".join(WORDS)])], "query_id int, question string")
    own = s.lexical()
    assert (own.n, round(own.avgdl, 9)) == (whole.n, round(whole.avgdl, 9))
    idf = lambda x: {(r["term"], r["df"], round(r["idf"], 9)) for r in x.terms.collect()}
    assert idf(own) == idf(whole)
    for where in (None, lambda c: c["document_type"] == "y"):
        got, want = (sorted(map(tuple, i.search(asked, 7, where, "pos").collect())) for i in (own, whole))
        assert got == want and got


def test_segments_score_as_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "SEGMENTS", 3)
    s = Store(spark, f"{tmp_path}/s")
    kinds = "xyz"
    sizes = []
    for step, (lo, hi) in enumerate([(0, 60), (5, 64), (30, 75), (33, 90)]):
        s.sync(chunks(spark, [("a", text(k) + f" n{k % 40}", f"t{k % 3 if step != 2 else 0}", kinds[k % 3]) for k in range(lo, hi)] + ([("b", f"only {text(step)}", "t", "y")] if step == 1 else [])))
        sizes.append(len(s.manifest().segments))
        if step in (1, 3):
            same_index(spark, s, f"{tmp_path}/i{step}")
    assert max(sizes) <= 3 and sizes[:3] == [1, 2, 3]
    assert s.sync(chunks(spark, [("c", "x", "t", "x")])).count() == 1 and s.read(source="c").count() == 1


def test_a_source_is_emptied_by_its_last_chunks(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.sync(chunks(spark, [("a", "one two", "t", "x"), ("b", "two three", "t", "x"), ("b", "five", "t", "x"), ("b", "six", "t", "x"), ("b", "seven", "t", "x")]))
    s.sync(chunks(spark, [("a", "four", "t", "x")]))
    assert sorted(r["text"] for r in s.read().collect()) == ["five", "four", "seven", "six", "two three"]
    found = s.lexical().search(spark.createDataFrame([(1, "one two four")], "query_id int, question string"), 5, key="pos").join(s.read(), "pos")
    assert sorted(r["text"] for r in found.collect()) == ["four", "two three"]


def test_a_lost_merge_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = Store(spark, f"{tmp_path}/s")
    s.sync(chunks(spark, [("a", "one", "t", "x")]))
    monkeypatch.setattr(module, "write_segment", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        s.sync(chunks(spark, [("a", "two", "t", "x")]))
    monkeypatch.undo()
    assert [r["text"] for r in s.read().collect()] == ["one"]
    assert [tuple(r) for r in s.sync(chunks(spark, [("a", "two", "t", "x")])).collect()] == [("a", 1, 0, 1)]
    assert [r["text"] for r in s.read().collect()] == ["two"]
