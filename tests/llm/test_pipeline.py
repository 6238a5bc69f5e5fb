import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language, packing, pii
from tests.llm.test_jaccard import plain

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    """Near copies by all pairs, personal data by the base patterns, bins by their rules."""
    pytest.importorskip("pyarrow")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = language.fit(docs)
    rows = [r for r, (_, _, no) in zip(rows, model.predict([t for _, t in rows]), strict=True) if not no]
    assert len(rows) > 0.95 * docs.count()
    keep = {i for i, c, _ in plain(rows) if i == c}
    clean = {r.doc_id: r.text for r in pii.redacted(docs.where(F.col("doc_id").isin(sorted(keep)))).collect()}
    got = corpus_pipeline.run(spark, SF).orderBy("doc_id", "piece").collect()
    made = {}
    for r in got:
        made[r.doc_id] = made.get(r.doc_id, "") + r.text
    assert made == clean
    bins = {}
    for r in got:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + len(r.text)
    assert max(bins.values()) <= packing.CAPACITY


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, near_rank_x string, lang_pred string, class_id int"
    rows = [(k, f"the house of the cat and the word number {'abcdefghij'[k % 10]} " * 9 + str(k) * 3, "en", "s", 1, "x", "y", 1) for k in range(30)]
    rows += [(None, rows[0][1], None, None, None, None, None, None), (None, "the other text of a document without any id at all", None, None, None, None, None, None), (None, None, "en", "s", 0, "", "", 0), (50, "", None, None, 0, None, None, None), (3, rows[3][1], "en", "s", 1, "x", "y", 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert [f.name for f in docs.schema] == [f.name for f in spark.createDataFrame([], schema).schema], name
    texts = sorted(r.doc_id is None for r in docs.collect())
    assert texts == [False] * 10 + [True]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_different_texts_of_one_id_stay(spark):
    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(5, base[0]), (5, base[1]), (5, base[1]), (3, base[1] + " x"), (5, None), (5, base[2]), (7, base[2] + " y"), (8, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(5, base[0]), (3, base[1] + " x"), (5, ""), (5, base[2]), (8, ""), (9, "")])


def test_copies_that_all_lack_an_id(spark):
    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(None, base[0]), (None, base[0]), (None, base[0] + " x"), (None, base[1]), (None, base[2]), (None, base[2] + " y"), (4, base[2] + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text[:2]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == [(4, "c0"), (None, "a0"), (None, "b0")]


def test_columns_of_any_name_keep_their_values(spark):
    names = ["near_text_", "near_key_", "near_text", "near_rank", "language_stage_lang_pred", "language_stage_", "class_id", "bare", "least", "best"]
    rows = [(k, "en", f"the house of the cat and the dog, number {k} of them all in the garden " * 3 + str(k) * 9, *[f"{n}{k}" for n in names]) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "lang", "text", *names], name
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names), name
    assert docs.count() > 0
