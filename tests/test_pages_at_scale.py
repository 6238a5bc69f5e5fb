"""Page maps and page lookups of long sources: the same in blocks as in one piece, and spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, pages


@pytest.fixture
def small(monkeypatch):
    """Blocks of 4 pages and stretches of 32 characters, so that short sources have many."""
    monkeypatch.setattr(pages, "BLOCK_BITS", 2)
    monkeypatch.setattr(pages, "STRETCH_BITS", 5)


def raw(seed, sources=("a", "b", None)):
    draw = random.Random(seed)
    texts = ["harbour", "well-", "known facts", "Upper case", "self-", "made", "x", "long text of a page, with words", "a\n\nb", "éclair", "-"]
    return [(s, n, draw.choice(texts)) for s in sources for n in sorted(draw.sample(range(1, 200), 60))]


def joined(rows):
    """The map of one source in plain steps: a seam closes where a word goes on over it."""
    out, at = [], 0
    for (s, n, t), after in zip(rows, [r[2] for r in rows[1:]] + [None], strict=True):
        seam = after is not None and len(t) > 1 and t[-1] == "-" and "a" <= t[-2] <= "z" and after[:1].islower()
        if seam:
            t = t[:-1]
        sep = "" if after is None or seam else "\n"
        out.append((s, n, t, at, at + len(t), sep))
        at += len(t) + len(sep)
    return out


def test_maps_in_blocks_as_in_one_piece(spark, small):
    rows = raw(3, ("a", "b"))
    got = pages.page_map(spark.createDataFrame(rows, "source string, page_number int, text string").withColumn("printed_page", F.col("page_number")))
    want = [r for s in "ab" for r in joined([x for x in rows if x[0] == s])]
    assert sorted((r.source, r.page_number, r.text, r.char_start, r.char_end, r.separator) for r in got.collect()) == sorted(want)


def test_pages_of_positions_as_by_a_linear_search(spark, small):
    rows = raw(5, ("a", "b"))
    mapped = pages.page_map(spark.createDataFrame(rows, "source string, page_number int, text string").withColumn("printed_page", F.when(F.col("page_number") % 5 > 0, F.col("page_number") - 3)))
    draw = random.Random(1)
    asked = [(k, draw.choice(["a", "b", "none"]), draw.choice([0, -4, None, draw.randrange(900), draw.randrange(900)]), "kept") for k in range(150)]
    found = pages.pages_at(mapped, spark.createDataFrame(asked, "k int, source string, position long, at_x string"), "position", "page").collect()
    assert len(found) == len(asked)
    own = {}
    for r in sorted(mapped.collect(), key=lambda r: r.char_start):
        own.setdefault(r.source, []).append((r.char_start, r.printed_page))
    for r in found:
        spans = own.get(r["source"], [])
        hit = [p for a, p in spans if r["position"] is not None and a <= r["position"]] or [p for _, p in spans[:1]] or [None]
        assert r["page"] == hit[-1], r
    assert pages.pages_at(mapped.limit(0), spark.createDataFrame(asked, "k int, source string, position long, x string"), "position", "page").where("page is null").count() == len(asked)


def test_one_source_of_many_pages_is_many_tasks(spark):
    n = 200_000
    own = spark.range(1, n + 1, numPartitions=8).selectExpr("'book' as source", "cast(id as int) as page_number", "concat('page ', id) as text", "cast(id as int) as printed_page")
    mapped = pages.page_map(own)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = mapped.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("char_end").alias("end")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(shares) == 8 and max(r["n"] for r in shares) < n / 3
    assert max(r["end"] for r in shares) == sum(len(f"page {k}") + 1 for k in range(1, n + 1)) - 1


def test_seeded_rows(spark):
    rows = [(s, k) for s in "ab" for k in range(40)] + [("c", 1)]
    df = spark.createDataFrame(rows, "source string, k int")
    draw = lambda seed, parts: sorted(map(tuple, evaluation.seeded_rows(df.repartition(parts), ["k"], 5, seed, by=["source"]).collect()))
    one = draw(7, 1)
    assert one == draw(7, 6) and one != draw(8, 6) and len(one) == 11
    assert [p for s, _, p in one if s == "c"] == [1]
    assert evaluation.seeded_rows(df, ["k", "source"], 4, 1).count() == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_makes_a_text_once(spark):
    own = spark.createDataFrame([(1, k, f"{k} A TITLE\nwell-\nknown well-known\n{k}") for k in range(1, 4)], "source long, page_number int, text string")
    assert not [x for x in plan_of(pages.clean(own)).split("\n") if "Filter" in x and "aggregate(" in x]
    assert plan_of(pages.extract(own)).count("Exchange") < 12  # what is read twice is held
    assert [r["clean_text"] for r in pages.extract(own).collect()] == ["well-known well-known\n" * 2 + "well-known well-known"]


def test_page_lookups_make_the_map_once(spark):
    from tessera import catalog

    assert plan_of(catalog.QUERIES["page_asof"](spark, "/root/testdata/sf0.001")).count("Exchange") < 12
