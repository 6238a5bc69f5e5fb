import numpy as np
import pytest

from tessera.llm.common import Forest
from tessera.llm.embedding import Index, near_vectors


def plain(rows, least=0.93):
    unit = lambda v: (w := np.array(v, float) / max(map(abs, v))) / np.linalg.norm(w)
    ok = [(i, str(b), unit(v)) for i, b, v in rows if i is not None and b is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    sets, n = Forest(len(ok)), [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][1] == ok[b][1] and ok[a][2] @ ok[b][2] >= least:
                sets.join(a, b)
                n[a] += 1
                n[b] += 1
    groups = {}
    for k in range(len(ok)):
        groups.setdefault(sets.root(k), []).append(ok[k][0])
    found = {ok[k][0]: (n[k], min(groups[sets.root(k)])) for k in range(len(ok))}
    return sorted(((i, *found.get(i, (0, i))) for i, *_ in rows), key=str)


@pytest.mark.parametrize("block", [40, 1024])
def test_recall_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 6) if k else 150):
            rows.append((len(rows) * 3 + 1, int(k % 4) if k % 9 else 0, (c + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2, 0.3]) * np.linalg.norm(c) / 4).tolist()))
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 9]
    rows += [(10_000 + k, 1, v) for k, v in enumerate(bad)] + [(20_000, None, rows[0][2]), (None, 0, rows[0][2]), (20_001, 0, [x * 1e-200 for x in rows[0][2]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as component_id", "2 as own").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, block=block, lists=12).collect()), key=str)
    want = plain(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert near_vectors(df.limit(0)).count() == 0 and near_vectors(df.where("vec_id = 10000")).count() == 1


def test_distances_and_errors():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = Index(v, 5)
    codes, error = index.encode(v, np.full(600, 2))
    d = index.distances(v[:50], 2, codes)
    true = np.linalg.norm(v[:50, None] - v[None], axis=2)
    assert (np.abs(d - true) <= error[None] + 1e-9).all()


def test_vectors_of_other_lengths(spark):
    rows = [(k, 0, [float(k % 7 + 1), float(k)] + [1.0] * 14) for k in range(0, 60)]
    rows += [(100, 1, [1.0, 2.0, 3.0]), (101, 1, [1.0, 2.0, 3.0]), (102, 1, [3.0, -2.0, 1.0]), (103, 1, [1.0] * 5), (104, 2, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).where("vec_id >= 100").collect()}
    assert got == {100: (1, 100, True), 101: (1, 100, False), 102: (0, 102, True), 103: (0, 103, True), 104: (0, 104, True)}


def exact(rows, least=0.93):
    """(row's id, links, component) with each (id, label, vector) a vector of its own, by all pairs."""
    nodes = sorted({(i, b, tuple(v)) for i, b, v in rows})
    unit = [np.array(v) / np.linalg.norm(v) for *_, v in nodes]
    near = np.stack(unit) @ np.stack(unit).T >= least
    near &= np.array([n[1] for n in nodes])[:, None] == np.array([n[1] for n in nodes])[None]
    np.fill_diagonal(near, False)
    sets = Forest(len(nodes))
    for a, b in zip(*np.nonzero(near)):
        sets.join(int(a), int(b))
    low = {}
    for k, n in enumerate(nodes):
        low[sets.root(k)] = min(low.get(sets.root(k), n[0]), n[0])
    of = {n: (int(near[k].sum()), low[sets.root(k)]) for k, n in enumerate(nodes)}
    return sorted((i, *of[i, b, tuple(v)]) for i, b, v in rows)


def test_all_links_in_64_dimensions(spark):
    """Groups of near copies around random centres, one of 400, and exact copies: probing half the radius misses nothing."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(250):
        c = rng.normal(size=64)
        for _ in range(400 if k == 0 else rng.integers(1, 8)):
            rows.append((len(rows), k % 3, (c + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.25, 0.35])).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    want = exact(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, block=64, lists=20).collect()) == want
    assert sum(w[1] for w in want) > 10_000


def test_repeated_ids(spark):
    v, w, far = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [3.0, -2.0, 0.0]
    rows = [(5, 0, v), (5, 0, v), (7, 0, v), (7, 0, w), (8, 0, far), (3, 0, far), (3, 1, v), (9, 1, w)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect()) == exact(rows)
    assert [r[1] for r in exact(rows) if r[0] == 7] == [2, 2] and exact(rows)[0][0] == 3
