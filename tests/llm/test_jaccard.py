import random

import numpy as np
import pytest

from tessera.llm import common, jaccard
from tessera.llm.common import components


def plain(rows, threshold=0.8):
    """(doc_id, class, links) by comparing all pairs of rows with ids."""

    def grams(t):
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    g = [grams(t) for _, t in rows]
    lead, n = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if g[i] and g[j] and len(g[i] & g[j]) >= threshold * len(g[i] | g[j]):
                n[i] += 1
                n[j] += 1
                a, b = lead[i], lead[j]
                lead = [min(a, b) if x in (a, b) else x for x in lead]
    sets = {}
    for k, x in enumerate(lead):
        sets.setdefault(x, []).append(rows[k][0])
    return sorted((rows[k][0], min(sets[lead[k]]), n[k]) for k in range(len(rows)))


def make(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words) + rng.choice(["", "x"])
        if rng.random() < 0.3:
            w += shared
        texts.append(rng.choice([" ", "\n"]).join(w))
    big = [rng.choice(words) for _ in range(300)]
    for k in range(n // 3):  # one large group of near copies
        w = list(big)
        w[rng.randrange(300)] = f"e{k}"
        texts.append(" ".join(w))
    return [(k * 7 + 3, t) for k, t in enumerate(texts)] + [(1_000_000, ""), (1_000_001, " \n "), (1_000_002, "")]


@pytest.mark.parametrize("block", [16, 256])
def test_against_all_pairs(spark, block):
    rows = make(9, 240)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_copies(df, block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == plain(rows)
    assert all(r.kept == (r.class_id == r.doc_id) for r in got)


def test_edges(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(None, None), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, None), (None, "only here and without id"), (8, long), (9, long + " more"), (10, "one"), (11, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class_id", "'x' as bands")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.kept) for r in jaccard.near_copies(df).collect())
    assert got == sorted([("None", "None", 0, True), ("None", "5", 2, False), ("5", "5", 2, True), ("5", "5", 2, True), ("6", "6", 0, True), ("None", "None", 0, True), ("8", "8", 1, True), ("9", "8", 1, False), ("10", "10", 1, True), ("11", "10", 1, False)])
    assert jaccard.near_copies(df.limit(0)).count() == 0


def test_posterior_table():
    least = jaccard.least_matches(0.8, 1e-9)
    assert len(least) == 4 and list(least) == sorted(least) and 5 <= least[0] <= 15 and 60 < least[-1] < 90
    rng = np.random.default_rng(0)
    assert all((rng.binomial(n, 0.8, 200_000) >= m).all() for n, m in zip((32, 64, 96, 128), least, strict=True))


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(k, k + 1) for k in range(5000, 5300)] + [(7000, k) for k in range(7001, 7300)]
    sets = common.Forest(8000)
    for a, b in links:
        sets.join(a, b)
    want = sorted((k, sets.root(k)) for k in {x for e in links if e[0] != e[1] for x in e})
    df = spark.createDataFrame(links, "u long, v long")
    for few in (100_000, 40):
        assert sorted(map(tuple, components(df, few).collect())) == want
