import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import lm


def plain_whole(rows, target):
    """Both models over all their pairs, by dictionaries; the unknown word is None."""
    split = lambda t: (t or "").lower().replace("\n", " ").split()
    uni = Counter(w for i, t in rows if i in target for w in split(t))
    words = {w for w, n in uni.items() if n >= lm.LEAST}
    mapped = [(i, [w if w in words else None for w in split(t)]) for i, t in rows]
    models = []
    for own in ([w for i, w in mapped if i in target], [w for _, w in mapped]):
        one, two = Counter(), Counter()
        for w in own:
            one.update(w)
            two.update(p for p in zip(w, w[1:]) if p[0] is not None)
        context = Counter()
        for p, n in two.items():
            context[p[0]] += n
        models.append((one, two, context, sum(one.values()) + len(words) + 1))
    out = []
    for i, w in mapped:
        loss = []
        for one, two, context, scale in models:
            before = [None, *w[:-1]]
            loss.append(-sum(math.log2((two[v, x] + lm.WEIGHT * (one[x] + 1) / scale) / (context[v] + lm.WEIGHT)) for v, x in zip(before, w)))
        out.append((i, len(w), *(round(x / max(1, len(w)), 6) for x in loss)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [10, 2_000_000])
def test_whole_against_plain_models(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(lm, "FEW_IDS", few)
    rng = random.Random(9)
    words = ["The", "the", "a", "of", "cat", "dog", "é", *(f"w{k}" for k in range(90))]
    rows = [(k, rng.choice([" ", "\n"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 20)))) for k in range(200)]
    rows += [(None, "the cat"), (None, None), (300, None), (301, " "), (302, "the cat of a dog new " * 3000), (5, rows[5][1])]
    target = set(range(0, 200, 5))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/d")
    ids = spark.createDataFrame([(k,) for k in [*target, None, 999, 0]], "doc_id long")
    got = lm.whole_difference(spark.read.parquet(f"{tmp_path}/d"), ids).collect()
    assert sorted(((r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6)) for r in got), key=str) == plain_whole(rows, target)


def test_query_counts_pairs_of_the_background_alone(spark, tmp_path):
    """'the dog' is nowhere in the target: it must weigh on 'cat' after 'the' in the background, and be unlike the target."""
    from tessera.llm.queries import op10_lm

    rows = [(k, "the cat" if k < 10 else "the dog") for k in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 10)) for k in range(1000)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    score = {r.doc_id: r.score for r in op10_lm(spark, str(tmp_path)).collect()}
    assert score[0] < -2.5 and score[500] > 2.5


def test_whole_empty(spark):
    docs = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert lm.whole_difference(none, none).count() == 0
    assert [(r.n_tokens, r.score) for r in lm.whole_difference(docs, none).collect()] == [(4, 0.0)]


def test_many_chunks_and_ranges(spark, tmp_path):
    """Chunks of a few documents, one longer than a chunk, and many hash ranges give the same scores."""
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choices([f"w{x}" for x in range(30)], k=rng.randint(0, 30)))) for k in range(120)] + [(500, "w1 w2 zz " * 900), (None, "w3 w4")]
    target = set(range(0, 120, 4))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    ids = spark.createDataFrame([(k,) for k in target], "doc_id long")
    got = lm.whole_difference(spark.read.parquet(f"{tmp_path}/d"), ids, chunk=300, span=500)
    assert "Exchange hashpartitioning(part" in got._jdf.queryExecution().toString()
    assert sorted(((r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6)) for r in got.collect()), key=str) == plain_whole(rows, target)


def test_answers_of_another_chunk_are_refused():
    words = [lm.Words([t], np.array([True])) for t in ("a b c", "a b d")]
    sent = [m for k, w in enumerate(words) for m in w.asked.messages(k, 1)]
    told = pa.Table.from_batches(list(lm._answers(iter([lm._rows(sent, lm._MESSAGE)]), lm._WORDS))).filter(pc.is_valid(pc.field("chunk")))
    for k, w in enumerate(words):
        own = told.filter(pc.field("chunk") == k)
        assert sorted(lm._known(w, own)[2].tolist()) == [1, 2, 2]
        with pytest.raises(RuntimeError):
            lm._known(words[1 - k], own)
