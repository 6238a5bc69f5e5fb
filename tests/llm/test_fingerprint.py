import hashlib

import numpy as np

from tessera.llm import fingerprint as fp
from tessera.llm.common import shingle_hashes


def brute(rows):
    """(doc_id, n_chars, sha of the edit, near_edited) by plain loops over sorted rows."""
    key = lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")
    rows = sorted(rows, key=key, reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = fp.edited(t, u)
        a, b, c = fp.sketches([t, e, u])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.containment(a, b), fp.containment(a, c)))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", __import__("pyspark").sql.functions.lit("x"))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fp.edit_likeness(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}é" for k in range(300)]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 90)))) for i in rng.permutation(400) * 3]
    check(spark, rows + [(9999, "x" * 50_000 + " " + "a b c d e f " * 20_000)])


def test_nulls_ties_and_small_tables(spark):
    check(spark, [(None, None), (None, "a b"), (4, None), (4, "same text here"), (4, "same text here"), (7, ""), (8, "😀 a\tb\nc d e f")])
    check(spark, [(5, "only one document of a few words")])
    check(spark, [])


def test_repeated_rows_and_one_id(spark):
    """A row that is repeated, and an id that many texts have, fill many ranges; none holds most of the rows."""
    rows = [(7, "the same text of some words in a row")] * 1500 + [(9, f"text {k:04} of one id " * 3) for k in range(1200)] + [(k, f"own text {k}") for k in range(400)] + [(None, "no id")] * 300
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fp.edit_likeness(df).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert max(r["count"] for r in got) < 0.3 * len(rows)


def test_columns_against_the_texts(spark):
    """Fingerprints of rows are those of their texts and edits, whoever made them."""
    rows = [(k, " ".join(f"w{(k * x) % 97}" for x in range(60))) for k in range(30)]
    got = {r.doc_id: r for r in fp.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        e = fp.edited(t, rows[k - 1][1])
        h = sorted({int(x) for x in shingle_hashes([t])[0]})
        low = [x for x in h if x < 2**64 // fp.SCALE] or h[:1]
        assert got[k].fingerprint == "".join(f"{x:016x}" for x in low)
        other = {int(x) for x in shingle_hashes([e])[0]}
        other = {x for x in other if x < 2**64 // fp.SCALE} or {min(other)}
        assert got[k].edited_fingerprint == "".join(f"{x:016x}" for x in sorted(other))
        assert got[k].near_edited == len(other & set(low)) / len(low)


def test_sketches():
    texts = [" ".join(f"t{k}" for k in range(a, b)) for a, b in ((0, 5000), (4000, 5000), (9000, 9003))] + ["", " \n"]
    a, b, short, empty, blank = fp.sketches(texts)
    assert abs(len(a) - 4996 / fp.SCALE) < 100
    assert fp.containment(b, a) == 1 and 0.1 < fp.containment(a, b) < 0.3
    assert len(short) == 1 and not len(empty) and not len(blank) and fp.containment(empty, blank) == 1 and fp.containment(empty, a) == 0
    assert (fp.merge(a, b) == a).all() and set(a) <= set(fp.merge(short, a)) and (fp.from_text(fp.to_text(a)) == a).all()
    h, of = shingle_hashes(["a b c d e f", "a b c d e", "b c d e f", "a b"])
    assert h[0] == h[2] and h[1] == h[3] and list(of) == [0, 0, 1, 2, 3]
    long_word = "y" * 5000
    assert len(set(shingle_hashes([long_word, long_word + "y", "z" + long_word])[0].tolist())) == 3
