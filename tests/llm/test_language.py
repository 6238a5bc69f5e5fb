import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language as lid
from tessera.llm.queries import op4_language

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    """n-grams of the padded words of a text, by loops."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = np.zeros(lid.BUCKETS)

    def add(gram):
        m = [lid._MUL[:1], lid._MUL[1:3], lid._MUL[3:]][len(gram) - 1]
        h = sum(ord(c) * int(x) for c, x in zip(gram, m, strict=True)) % 2**32
        h = (h ^ (h >> 15)) * 2246822519 % 2**32
        found[h >> 20] += 1

    for w in words:
        for c in w:
            add(c)
        for g in (2, 3):
            p = f" {w} "
            for k in range(len(p) - g + 1):
                add(p[k : k + g])
    return found


def test_counts():
    texts = ["Où est-il? 12 a", "", "...", "x", "Straße  und\nWeg", "日本"]
    found, letters = lid.counts(texts)
    assert list(letters) == [8, 0, 0, 1, 12, 2]
    for t, f in zip(texts, found, strict=True):
        assert (plain_counts(t) == f).all(), t


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op4_language(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id")
    test = got.where("held_out and lang_pred <> 'und'").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.max("score")).first()
    assert test[0] > 150 and test[1] > 0.97 and 0 < test[2] <= 1
    assert got.count() == docs.count()
    assert got.where("rejected and text rlike '[A-Za-z]{3}'").count() == 0


def test_edges(spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice(["the cat and", "of a house", "with these"], 30)) if k % 2 else "der die und das nicht ein Haus für", ["de", "en"][k % 2], "x") for k in range(60)]
    rows += [(None, None, None, None), (100, "", "en", ""), (101, "12 !", None, ""), (102, "Ωμέγα και άλφα " * 20, None, ""), (102, "Ωμέγα και άλφα " * 20, None, ""), (103, "the house " * 30_000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang): r for r in lid.identify(df, lid.fit(df)).collect()}
    assert [got[k].lang_pred for k in ((None, None), (100, "en"), (101, None))] == ["und"] * 3
    assert got[102, None].rejected and got[103, None].lang_pred == "en" and not got[103, None].rejected
    assert all(r.lang_pred == r.lang and not r.rejected and 0 < r.score <= 1 for r in got.values() if r.doc_id is not None and r.doc_id < 60)
    none = spark.createDataFrame([], df.schema)
    assert lid.identify(none, lid.fit(none)).count() == 0
    assert {r.rejected for r in lid.identify(df.limit(3), lid.fit(none)).collect()} == {False}


def test_predictions_against_loops(spark):
    """The nearest centroid and the rejection, text by text, from the counts of plain loops."""
    rng = np.random.default_rng(3)
    words = {"en": "the cat and of house with these words in".split(), "fr": "le chat et de la maison avec ces mots".split(), "de": "der hund und das haus mit diesen worten".split()}
    rows = [(k, " ".join(rng.choice(words[lang], rng.integers(3, 40))), lang) for k, lang in enumerate(list(words) * 40)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows[:40]] + ["", "12", "a", "zzz qqq xxx " * 30, "The House und die Maison"]
    for t, (lang, score, rejected) in zip(texts, model.predict(texts), strict=True):
        letters = sum(c.isalpha() for c in t)
        v = np.log1p(plain_counts(t)) * model.idf
        cosines = [float(v @ c) / max(np.linalg.norm(v), 1e-9) for c in model.centroids]
        best = max(cosines)
        if not letters:
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        assert abs(score - best) < 1e-5 and cosines[model.langs.index(lang) :][: lid.CENTROIDS * 3]
        assert max(c for c, x in zip(cosines, model.langs, strict=True) if x == lang) > best - 1e-5
        assert rejected == (best < model.least * letters / (letters + lid.FEW_LETTERS)) or abs(best - model.least * letters / (letters + lid.FEW_LETTERS)) < 1e-4
    found = np.stack([plain_counts(t) for _, t, _ in rows])
    taken = [k for k in range(len(rows)) if __import__("zlib").crc32(str(k).encode()) % 5]
    assert np.allclose(model.idf, np.log((1 + len(taken)) / (1 + (found[taken] > 0).sum(0))) + 0.1)


def test_one_id_for_all_rows(spark):
    """A repeated row is learned from once, and different texts of one id are sampled each."""
    same = spark.range(50_000).selectExpr("7L as doc_id", "'the same text of one id' as text", "'en' as lang")
    model = lid.fit(same.unionByName(spark.range(2000).selectExpr("7L as doc_id", "concat('der hund ', id) as text", "'de' as lang")), sample=100)
    assert model.langs.count("en") == 1 or model.langs.count("en") == 0
    assert "de" in model.langs


def test_more_labels_than_a_fit_takes(spark, monkeypatch):
    """The labels of most rows are learned, and each label gets a share of the bounded sample."""
    monkeypatch.setattr(lid, "LABELS", 3)
    monkeypatch.setattr(lid, "ROWS", 30)
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text of label ', id % 7, ' number ', id) as text", "concat('l', least(id % 7, 4)) as lang").where("lang <> 'l0' or doc_id % 2 = 0")
    model = lid.fit(docs)
    assert len(set(model.langs)) == 3 and "l4" in model.langs and "l0" not in model.langs
    got = lid.identify(docs.limit(20), model).collect()
    assert len(got) == 20 and {r["lang_pred"] for r in got} <= set(model.langs)
    assert lid.fit(spark.range(8001).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang")).langs
