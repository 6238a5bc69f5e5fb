import random

from tessera.llm.packing import _numbers, best_fit, normal, pack


def plain(items, capacity, per_source):
    """Best fit by looking at every bin each time."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and b["s"].count(source) < per_source and (cluster < 0 or cluster not in b["c"])]
        if not fit:
            bins.append({"left": capacity, "s": [], "c": []})
            fit = [(capacity, len(bins) - 1)]
        b = bins[min(fit)[1]]
        out.append((min(fit)[1], capacity - b["left"]))
        b["left"] -= size
        b["s"].append(source)
        b["c"].append(cluster)
    return out


def test_best_fit_against_plain():
    rng = random.Random(3)
    for per_source in (1, 2, 4):
        items = sorted(((rng.choice([rng.randint(1, 100), 30]), rng.choice([0, 0, rng.randint(0, 9)]), rng.choice([-1, 0, rng.randint(0, 30)])) for _ in range(700)), reverse=True)
        assert best_fit(items, 100, per_source) == plain(items, 100, per_source)


def test_best_fit_under_many_conflicts():
    """One cluster, or one source, holds most items: whole blocks of bins conflict."""
    rng = random.Random(5)
    for items in ([(10, k % 7, 0) for k in range(600)], [(rng.randint(1, 9), 0, -1) for _ in range(900)], [(rng.randint(1, 40), rng.choice([0, 0, 0, 1]), rng.choice([-1, 0, 0, 1])) for _ in range(1500)]):
        items = sorted(items, reverse=True)
        assert best_fit(items, 100, 2) == plain(items, 100, 2)


def test_repeated_rows_and_long_text(spark):
    """Thirty thousand rows of one text and no id spread over the shards; a text of many bins is cut."""
    import time

    many = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "'the same short text' as text", "'s' as source")
    begin = time.time()
    got = pack(many.unionByName(spark.createDataFrame([(1, "y" * 9_000_000, "t")], "doc_id long, text string, source string")))
    rows = got.groupBy("doc_id").agg({"*": "count", "end": "sum", "start": "sum"}).collect()
    counts = {r.doc_id: (r["count(1)"], r["sum(end)"] - r["sum(start)"]) for r in rows}
    assert counts == {None: (30_000, 30_000 * 19), 1: (1099, 9_000_000)}
    assert got.where("doc_id is null").select("bin_id").distinct().count() == 30_000  # copies never share a bin
    assert time.time() - begin < 60


def test_pack(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.choice([1, 5, 30, 99, 100, 101, 350]) + str(k % 17), f"s{k % 5 * (k % 3 > 0)}") for k in range(500)]
    rows += [(None, None, None), (3, "", "s1"), (900, "same text", None), (900, "same text", None), (901, "Same  TEXT", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin_id", normal("text"))
    got = [tuple(r) for r in pack(df, capacity=100, with_text=True).collect()]
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(t or "")
    assert sum(r[3] - r[2] for r in got) == sum(len(r[1] or "") for r in rows)
    assert sorted(r[0] is None for r in got if r[4] is None) == [False, True]
    bins = {}
    for i, p, a, b, n, o, t in got:
        assert any(x[a:b] == t for x in texts[i]) and p == a // 100
        if n is not None:
            bins.setdefault(n, []).append((o, b - a, i))
    source = {r[0]: r[2] for r in rows}
    for own in bins.values():
        at = 0
        for o, n, _ in sorted(own):
            assert o == at
            at += n
        assert at <= 100
        names = [source[i] for *_, i in own]
        assert max(map(names.count, names)) <= 4
        assert sum(i in (900, 901) for *_, i in own) <= 1
    bare = [tuple(r) for r in pack(df, capacity=100).collect()]
    assert sorted(map(str, bare)) == sorted(str(r[:6]) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack(df).count() == 0
    assert _numbers([None, 5, 5, 7], True) == [-1, 0, 0, -1]
