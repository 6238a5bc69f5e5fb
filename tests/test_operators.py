import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tokens, unquote
from tessera.operators import chunking, evaluation, expansion, fusion, grounding, lexical, pages, store
from tessera.sources import files, html


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tokens(F.col("t")), "Étion 14.8.5 a_b, über-x 3.") == ["étion", "14.8.5", "a_b", "über", "x", "3"]
    assert one(spark, tokens(F.col("t")), None) == []
    assert one(spark, unquote(F.col("t")), "“a”") == "a"


def test_bm25_filter_keeps_scores(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a a d", "y"), (3, "e f", "x"), (4, "g h", "y"), (5, None, "y")], "doc_id long, text string, kind string")
    q = spark.createDataFrame([(0, "a d")], "query_id long, question string")
    full = {r.doc_id: r.score for r in lexical.bm25(docs, q, 5).collect()}
    part = {r.doc_id: r.score for r in lexical.bm25(docs, q, 5, where=F.col("kind") == "y").collect()}
    assert part == {2: full[2]} and set(full) == {1, 2}
    assert lexical.bm25(docs.limit(0), q, 5).count() == 0


def test_fusion_ties_and_weights(spark):
    lists = spark.createDataFrame([(1, 0, 1.0, 10, 1), (1, 0, 1.0, 11, 2), (1, 1000, 1.0, 11, 1), (1, 1000, 1.0, 10, 2), (1, 1000, 1.0, 9, 3)], "query_id long, list_ord int, weight double, doc_id long, rank int")
    assert [r.doc_id for r in fusion.rrf(lists).orderBy("rank").collect()] == [10, 11, 9]
    q = spark.createDataFrame([(1, "Q one", ["q ONE", " r1 ", "", "R1", "r2"], "i")], "query_id long, question string, rewrites array<string>, intent string")
    assert [(r.ord, r.kind, r.text, r.weight) for r in fusion.sub_queries(q).orderBy("ord").collect()] == [(0, "original", "Q one", 1.0), (1, "rewrite", "r1", 0.25), (2, "rewrite", "r2", 0.25), (3, "intent", "i", 0.25)]
    assert fusion.sub_queries(q, 0.0).count() == 3
    for bad in (("all", 6, 0.2), ("hybrid", 0, 0.2), ("hybrid", 6, 0.6)):
        with pytest.raises(ValueError):
            fusion.check(*bad)


def test_expansion(spark):
    text = 'x\n1. "First one"\n2) first ONE\n- 12\n* INTENT: what it is\nINTENT: two\n3. ' + "y" * 201
    assert one(spark, expansion.intent(F.col("t")), text) == "what it is"
    assert one(spark, expansion.rewrites(expansion.without_intent(F.col("t"))), text) == ["First one"]
    assert one(spark, expansion.rewrites(F.col("t")), "plain\n1.\nother") == ["plain", "other"]
    q = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "odd")], "query_id long, question string")

    def call(x):
        if x == "bad":
            raise RuntimeError
        return "1. better\n2. good\nINTENT: meaning" if x == "good" else "12"

    got = {r.question: (r.status, r.rewrites, r.intent) for r in expansion.expand(q, call).collect()}
    assert got == {"good": ("live", ["better"], "meaning"), "bad": ("api_error", [], None), "odd": ("parse_error", [], None)}
    assert {r.status for r in expansion.expand(q, None).collect()} == {"no_key"}


def test_cached_expansions(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"one":{"rewrites":["a","b"],"status":"live","intent":"i"},"two":{"rewrites":[],"status":"api_error","intent":null}}')
    cached = expansion.read_cached(spark, f"{tmp_path}/c.json")
    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, "new")], "query_id long, question string")
    got = {r.query_id: (r.rewrites, r.status, r.intent) for r in expansion.replayed(q, cached).collect()}
    assert got == {1: (["a", "b"], "live", "i"), 2: ([], "api_error", None), 3: ([], "parse_error", None)}
    assert fusion.sub_queries(expansion.replayed(q, cached)).count() == 6


def test_page_invariants(spark):
    rows = [("s", 1, "ab", 0, 2), ("s", 2, "", 2, 2), ("s", 3, "cd\n", 2, 5), ("s", 4, "xyz", 4, 9), ("t", 1, "a", -1, 0)]
    mapped = spark.createDataFrame(rows, "source string, page_number int, text string, char_start int, char_end int")
    got = sorted((r.source, r.page_number, r.problem) for r in pages.invariants(mapped).collect())
    assert got == [("s", 2, "empty"), ("s", 3, "overlap"), ("s", 3, "untrimmed"), ("s", 4, "length"), ("t", 1, "negative")]


def test_grounding(spark):
    answers = [(1, "So [Handbook, para 3.2, p.5]."), (2, "So [H, para 3.2, p.5] and [H, Appendix 3.2, pp. 5-6]."), (3, " “Not covered in the source material.” "), (4, "Nothing."), (5, "[H, para 14.12, p.5]"), (6, "not covered in the source material [H, para 3, p.5]")]
    results = [(k, "3", 4, 6) for k in (1, 2, 3, 4)] + [(5, "14.1", 4, 6), (6, "3", None, None)]
    gated = grounding.gate(grounding.verify(spark.createDataFrame(answers, "query_id long, answer string"), spark.createDataFrame(results, "query_id long, section_number string, page_start int, page_end int")))
    assert {r.query_id: r.gate_outcome for r in gated.collect()} == {1: "CITATIONS_VERIFIED", 2: "PARTIALLY_VERIFIED", 3: "REFUSAL", 4: "CITATIONS_UNVERIFIED", 5: "CITATIONS_UNVERIFIED", 6: "CITATIONS_UNVERIFIED"}
    shown = {r.query_id: r for r in grounding.display(gated).collect()}
    assert shown[4].shown is None and shown[4].action == "blocked_unverified" and shown[3].action == "refusal_shown"


def test_evaluation(spark):
    text = "See para. 3 here. It is so [Handbook, para 14.8.5, p.412]. \"Quote\" e.g. This one! [A. B] Next\n- list item"
    assert one(spark, evaluation.sentences(F.col("t")), text) == ["See para. 3 here.", "It is so [Handbook, para 14.8.5, p.412].", '"Quote" e.g. This one!', "[A. B] Next", "- list item"]
    golden = spark.createDataFrame([(1, "direct", ["14.1"]), (2, "direct", ["9"])], "query_id long, type string, expected_sections array<string>")
    results = spark.createDataFrame([(1, 1, "14.12"), (1, 2, "14.1.3"), (1, 3, "14.1"), (2, 1, "")], "query_id long, rank int, section_number string")
    ranks = evaluation.first_match(golden, results, 6)
    assert {r.query_id: (r.strict_rank, r.related_rank) for r in ranks.collect()} == {1: (3, 2), 2: (None, None)}
    total = evaluation.hit_metrics(ranks, ["type"], also_total="type").where("type = 'overall'").first()
    assert (total.strict_hits_1, total.strict_hits_3, total.related_hits_3, round(total.strict_mrr, 4)) == (0, 1, 1, 0.1667)
    assert evaluation.wilson_value(0, 0) == (0, 0) and abs(evaluation.wilson_value(20, 20)[0] - 0.839) < 1e-3
    low, high = (round(one(spark, c, "x"), 6) for c in evaluation.wilson(F.lit(3), F.lit(10)))
    assert (low, high) == tuple(round(x, 6) for x in evaluation.wilson_value(3, 10))
    good = one(spark, evaluation.judge_record(F.col("t")), '```json\n{"claims":[{"claim":"a","verdict":"supported"},{"claim":"b","verdict":"x"}]}\n```')
    assert (good.ok, good.supported, good.unclear, good.faithfulness) == (True, 1, 1, 0.5)
    assert one(spark, evaluation.judge_record(F.col("t")), "{").error_type == "parse"
    # The draw of the generator that Python has for the seed, in the order of the keys.
    assert evaluation.seeded_sample(range(9), 3, 1) == [1, 2, 8] and evaluation.seeded_sample(range(805), 5, 0) == [41, 265, 394, 430, 776]
    assert evaluation.seeded_sample("ab", 5, 1) == ["a", "b"]


def test_pages(spark):
    raw = [(1, "front"), (3, "CHAPTER 1\nOPENING"), (4, "TITLE HERE 2\nself-made re-\ngis-\ntration now\nword re-"), (5, "3 TITLE HERE\ngain self-\nmade\n17"), (6, "TITLE HERE 4\n\n\n\nlast"), (7, "5 TITLE HERE")]
    df = spark.createDataFrame([("s", n, t) for n, t in raw], "source string, page_number int, text string")
    got = {r.page_number: (r.printed_page, r.text) for r in pages.clean(df).collect()}
    assert got == {1: (None, "front"), 3: (1, "CHAPTER 1\nOPENING"), 4: (2, "self-made registration now\nword re-"), 5: (3, "gain self-made"), 6: (4, "last")}
    doc = pages.extract(df).first()
    assert doc.clean_text == "front\nCHAPTER 1\nOPENING\nself-made registration now\nword regain self-made\nlast"
    assert [doc.clean_text[s.char_start : s.char_end] for s in doc.page_map][3] == "gain self-made"
    assert pages.invariants(pages.page_map(pages.clean(df))).count() == 0


def test_needed_words_are_enough(spark):
    """Cleaning with the words that lines may be broken in gives what all attested words would give."""
    import random

    rng = random.Random(4)
    parts = ["self-", "made", "re-", "gis-", "tration", "self-made", "up", "Up", "well-", "known", "well-known", "re-gis", "regis-tration", "a b-", "ünd", "x", "", " ", "17", "made-up-", "made-up"]
    rows = [(f"s{k % 3}", k, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))) for k in range(300)]
    df = spark.createDataFrame(rows, "source string, page_number int, text string").where("text <> ''")
    got = sorted(tuple(r)[:3] for r in pages.documents(pages.page_map(pages.clean(df))).collect())
    real = pages.needed_words
    pages.needed_words = pages.attested
    try:
        want = sorted(tuple(r)[:3] for r in pages.documents(pages.page_map(pages.clean(df))).collect())
    finally:
        pages.needed_words = real
    assert got == want and any("well-known" in r[1] for r in got)


def test_chunking(spark):
    cut = lambda t: spark.range(1).select(chunking.legislation(F.lit(t)).alias("s")).first()["s"]
    assert [(x.section_number, x.parent_section) for x in cut("intro\nPART I\nSection 1. A\nSection 2 B\npart II\n3.— C")] == [("", ""), ("", "PART I"), ("1", "PART I"), ("2", "PART I"), ("", "part II"), ("3", "part II")]
    assert [tuple(x) for x in cut(" \u00a0\x1c\n") + cut(None) + cut("\u00a0x\x1c")] == [("", "", ""), ("", "", ""), ("", "", "x")]
    pieces = chunking.split_text("aaaa. bbbb. cccc. dddd", 12, 6)
    assert all(len(p) <= 12 for p in pieces) and pieces[0].startswith("aaaa")
    body = "x" * 700
    text = f"front\nCHAPTER 1\nBIG TITLE\nintro\n1.1 First\n{body}\n1.2 Second\nshort\n1.2.1 Deep\n{body}\nAPPENDIX 1.1\nCHAPTER 2\nOTHER\n2.1 Only\n{body}\n02.2 no\n2.3 dots....9\nINDEX\n1.9 Never"
    found = chunking.reconciled(chunking.segments(text))
    assert [(s.chapter, s.number) for s in found] == [(1, "1.1"), (1, "1.2"), (2, "2.1")]
    assert "".join(text[s.start : s.end] for s in found) == text[text.index("CHAPTER 1") : text.index("INDEX")]
    docs = spark.createDataFrame([("s", "my_book.pdf", "handbook", text, [(1, 7, 0, len(text))])], "source string, title string, document_type string, clean_text string, page_map array<struct<page_number:int,printed_page:int,char_start:int,char_end:int>>")
    rows = chunking.chunk_handbook(docs).orderBy("chunk_ord").collect()
    assert rows[0].text.startswith("[my book, Ch.1 Big Title, para 1.1, p.7] CHAPTER 1") and rows[0].page_end == 7


def test_chapters_out_of_order(caplog):
    body = "x" * 700
    found = chunking.segments(f"CHAPTER 2\nTITLE\n2.1 First\n{body}\nCHAPTER 1\nOTHER\n1.1 Late\n{body}")
    assert [s.chapter for s in found] == [2, 2, 1, 1] and "ascending" in caplog.text
    with pytest.raises(ValueError, match="chapter"):
        chunking.segments("no chapters at all")


def test_last_runts_join_what_is_before_them():
    body = "x" * 700
    text = f"CHAPTER 1\nTITLE\n1.1 First\n{body}\n1.2 Second\n{body}\n1.3 Third\n{body}\n1.4 Runt\nshort\n1.5 Runt\nshorter"
    found = chunking.reconciled(chunking.segments(text))
    assert [s.number for s in found] == ["1.1", "1.2", "1.3"]
    assert "".join(text[s.start : s.end] for s in found) == text and text[found[-1].start : found[-1].end].endswith("shorter")


def test_documents_of_one_source_do_not_mix(spark):
    text = lambda n: f"CHAPTER {n}\nTITLE\n{n}.1 First\n" + "x" * 700
    docs = [("s", "a.pdf", "handbook", text(n), [(1, 10 * n, 0, len(text(n)))]) for n in (1, 2)]
    got = chunking.chunk_handbook(spark.createDataFrame(docs, "source string, title string, document_type string, clean_text string, page_map array<struct<page_number:int,printed_page:int,char_start:int,char_end:int>>")).collect()
    assert sorted((r.section_number, r.page_start, r.chunk_ord) for r in got) == [("1.1", 10, 0), ("2.1", 20, 0)]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/st", "m")
    def rows(*r):
        return spark.createDataFrame(list(r), "source string, text string, title string, chunk_ord int")

    def told(df):
        return {r.source: (r.added, r.updated, r.deleted) for r in s.sync(df).collect()}

    first = rows(("a", "t1", "x", 0), ("a", "t1", "x", 1), ("a", "t2", "x", 2), ("b", "t1", "x", 0))
    assert s.read() is None and told(first) == {"a": (2, 0, 0), "b": (1, 0, 0)}
    assert told(first) == {"a": (0, 0, 0), "b": (0, 0, 0)}
    assert told(rows(("a", "t1", "new", 0), ("a", "t3", "x", 1))) == {"a": (1, 1, 1)}
    assert sorted((r.source, r.text, r.title) for r in s.read().collect()) == [("a", "t1", "new"), ("a", "t3", "x"), ("b", "t1", "x")]
    with pytest.raises(ValueError):
        s.check_model("other")
    with pytest.raises(ValueError):
        s.sync(rows(("", "t", "x", 0)))


def test_sources(spark, tmp_path):
    page = "<html><head><title> </title></head><body><nav>n</nav><h1>Head &amp; x</h1><p>A<br>b<script>s</script></body></html>"
    r = html.load(spark.createDataFrame([("u", page), ("v", None)], "url string, html string"), "t").collect()
    assert [(x.title, x.text) for x in r] == [("Head & x", "Head & x\nA\nb")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("hello")
    (tmp_path / "d/b.HTML").write_text("<p>x</p>")
    (tmp_path / "d/c.pdf").write_bytes(b"p1|p3")
    got = files.walk(spark, f"{tmp_path}/d", "t", lambda b: b.decode().split("|")).collect()
    assert sorted((x.title, x.text) for x in got) == [("a.txt", "hello"), ("b.HTML", "x"), ("c.pdf", "p1\np3")]
    (tmp_path / "g.jsonl").write_text('{"question":"q","type":"direct","expected_sections":["3.10 "]}\n\n{"question":"r","type":"refusal","expected_sections":[]}\n')
    assert [(x.query_id, x.expected_sections) for x in files.golden_set(spark, f"{tmp_path}/g.jsonl").orderBy("query_id").collect()] == [(1, ["3.10"]), (3, [])]
    (tmp_path / "b.jsonl").write_text('{"question":"q","type":"direct","expected_sections":[]}\n')
    with pytest.raises(ValueError, match="line 1"):
        files.golden_set(spark, f"{tmp_path}/b.jsonl")
    with pytest.raises(ValueError):
        files.route("x.txt", "handbook")


def test_splitting_takes_time_by_the_text_not_by_its_window():
    text = " ".join("a" * 60_001)
    began = time.process_time()
    pieces = chunking.split_text(text, 80_000, 40_000)
    assert time.process_time() - began < 5
    assert [len(p) for p in pieces] == [79_999, 79_999, 40_001] and all(p in text for p in pieces)
