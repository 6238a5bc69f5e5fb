import math
import random
from collections import Counter

import pytest
from pyspark.sql.utils import AnalysisException

from tessera.operators import lexical


def plain(docs, questions, k, allowed=lambda d: True):
    """BM25 by dictionaries; documents and questions are split at blanks."""
    split = lambda t: (t or "").split()
    n, avg = len(docs), sum(len(split(t)) for _, t in docs) / max(1, len(docs))
    df = Counter(w for _, t in docs for w in set(split(t)))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = lexical.EPSILON * sum(raw.values()) / max(1, len(raw))
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = []
    for q, text in questions:
        scores = []
        for d, t in docs:
            if allowed(d):
                tf, dl = Counter(split(t)), len(split(t))
                s = sum(idf[w] * tf[w] * (lexical.K1 + 1) / (tf[w] + lexical.K1 * (1 - lexical.B + lexical.B * dl / avg)) for w in split(text) if tf[w])
                scores.append((-round(s, 6), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [2, 2048])
@pytest.mark.parametrize("named", [False, True])
def test_index_against_plain_scores(spark, tmp_path, monkeypatch, most, named):
    monkeypatch.setattr(lexical, "TERMS", 20)
    rng = random.Random(most)
    words = [f"w{x}" for x in range(40)]
    key = (lambda k: f"key {k:03}") if named else (lambda k: k)
    docs = [(key(k), " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(0, 12)))) for k in range(60)] + [(key(97), None), (key(98), "w1 w2"), (key(99), "w1 w2"), (key(96), "w1 w2")]
    asked = [(q, " ".join(rng.choices([*words, "unseen"], k=rng.randint(0, 6)))) for q in range(15)] + [(50, "w1 w1 w2"), (51, "")]
    df = spark.createDataFrame([(d, t, i % 3) for i, (d, t) in enumerate(docs)], f"doc {'string' if named else 'long'}, text string, kind int").repartition(3)
    lexical.LexicalIndex.build(df, f"{tmp_path}/i", key="doc", keep=("kind",), most=most)
    index = lexical.LexicalIndex(spark, f"{tmp_path}/i")
    q = spark.createDataFrame(asked, "query_id long, question string")
    told = lambda got: sorted((r.query_id, r.doc, r.score, r["rank"]) for r in got.collect())
    same = lambda a, b: [(x[0], x[1], x[3]) for x in a] == [(x[0], x[1], x[3]) for x in b] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b))
    assert same(told(index.search(q, 4, key="doc")), plain(docs, asked, 4))
    kind = {d: i % 3 for i, (d, _) in enumerate(docs)}
    assert same(told(index.search(q, 4, where=lambda c: c["kind"] == 1, key="doc")), plain(docs, asked, 4, lambda d: kind[d] == 1))


def test_blocks_that_cannot_reach_the_best_are_not_scored(spark, tmp_path):
    """Results are those of a plain search; of the pairs of a block and a question fewer are scored."""
    rng = random.Random(9)
    words = [f"w{x}" for x in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=[30 if x // 6 == k // 180 else 1 for x in range(60)], k=rng.randint(4, 40)))) for k in range(1800)]
    asked = [(q, " ".join(rng.choices(words[q % 10 * 6 : q % 10 * 6 + 6], k=3))) for q in range(12)] + [(20, "w59 w58"), (21, "w58 w58 w40 w1"), (22, "w3 w4 w5")]
    index = lexical.LexicalIndex.build(spark.createDataFrame(docs, "doc long, text string").coalesce(2), f"{tmp_path}/i", key="doc", most=64)
    pairs, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = index.search(spark.createDataFrame(asked, "query_id long, question string"), 5, key="doc", tally=(pairs, scored)).collect()
    want = plain(docs, asked, 5)
    mine = sorted((r.query_id, r.doc, r.score, r["rank"]) for r in got)
    assert [(a[0], a[1], a[3]) for a in mine] == [(a[0], a[1], a[3]) for a in want]
    assert pairs.value >= len(asked) * 28 and scored.value < 0.7 * pairs.value


def test_tasks_take_bounded_batches(spark, tmp_path, monkeypatch):
    """However much one partition holds, Python gets a batch's bytes and a row at a time, when an index is built and when it is searched; a
    search that a plan reads twice runs once, and the session's setting is as before."""

    def noted(run, name):
        def own(parts, *rest):
            def sizes():
                for b in parts:
                    with open(f"{tmp_path}/{name}", "a") as f:
                        f.write(f"{b.nbytes}\n")
                    yield b

            yield from run(sizes(), *rest)

        return own

    monkeypatch.setattr(lexical, "_blocks", noted(lexical._blocks, "build"))
    monkeypatch.setattr(lexical, "_best", noted(lexical._best, "search"))
    words = "array_join(transform(sequence(0, 49999), x -> concat('w', x + id % 7)), ' ')"
    docs = spark.range(0, 100, 1, 1).selectExpr("id as doc_id", f"{words} as text")
    index = lexical.LexicalIndex.build(docs, f"{tmp_path}/i")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = index.search(spark.createDataFrame([(1, "w3 w50004"), (2, "unseen")], "query_id long, question string"), 5)
    twice = sorted(map(tuple, found.unionAll(found).collect()))
    assert len(twice) == 10 and twice[::2] == twice[1::2]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    for name, row in (("build", 1 << 20), ("search", 12 << 20)):
        sizes = [int(x) for x in open(f"{tmp_path}/{name}")]
        assert max(sizes) < (16 << 20) + row and sum(sizes) > (30 << 20), name
    assert sum(sizes) < 1.5 * sum(r.nbytes for r in [spark.read.parquet(f"{tmp_path}/i/blocks").drop("id", "n", "total").toArrow()])


def test_a_stored_block_is_read_alone(spark, tmp_path):
    """However many blocks a file holds, one of full size has a row group to itself and small ones share one; no values of columns are kept beside them."""
    import pyarrow.parquet as pq

    word = "sha2(concat(id, ':', x), 256)"
    for name, rows, tokens in (("full", 6, 40_000), ("small", 120, 3)):
        docs = spark.range(0, rows, 1, 1).selectExpr("id as doc_id", f"array_join(transform(sequence(1, {tokens}), x -> {word}), ' ') as text")
        lexical.write_blocks(docs, f"{tmp_path}/{name}", "doc_id", most=1)
        (file,) = (tmp_path / name).glob("*.parquet")
        stored = pq.ParquetFile(file).metadata
        groups = [stored.row_group(k) for k in range(stored.num_row_groups)]
        assert stored.num_rows == rows and max(g.num_rows for g in groups) == {"full": 1, "small": 120}[name]
        assert not any(g.column(k).is_stats_set for g in groups for k in range(stored.num_columns))


def test_unfinished_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(AnalysisException):
        lexical.LexicalIndex(spark, f"{tmp_path}/none")
    docs.write.parquet(f"{tmp_path}/i/blocks")
    with pytest.raises(AnalysisException):
        lexical.LexicalIndex(spark, f"{tmp_path}/i")
    assert lexical.LexicalIndex.build(docs, f"{tmp_path}/i").n == 1
    empty = lexical.LexicalIndex.build(docs.limit(0), f"{tmp_path}/e")
    assert empty.n == 0 and empty.search(docs.selectExpr("doc_id as query_id", "text as question"), 3).count() == 0
