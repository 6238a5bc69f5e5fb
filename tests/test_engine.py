"""The engine from end to end over the made-up handbook and flat documents, with stand-in models."""

import json
import logging
import re

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import audit, evaluation
from tessera.operators.store import Store
from tessera.plans import matrix
from tessera.plans.engine import NO_RESULTS, WITHHELD, Engine
from tessera.sources import files, sample


def bag():
    """An embedder: words hashed into 64 places, of length 1."""
    import zlib

    def run(texts):
        out = []
        for t in texts:
            v = [0.0] * 64
            for w in re.findall(r"\w+", t.lower()):
                v[zlib.crc32(w.encode()) % 64] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def llm(prompt):
    """Cites the first header of its context; refuses skis, and forgets itself over flags."""
    question = prompt.rsplit("Question: ", 1)[1]
    if "skis" in question:
        return '"Not covered in the source material."'
    if "flags" in question:
        return "It is so [Handbook, para 99.9, p.1]."
    return "It is so " + re.search(r"^\[(?:Handbook|Source).*\]$", prompt.split("Context:\n", 1)[1], re.M)[0] + "."


def rewriter(question):
    return f"1. {question.lower().rstrip('?')} rule\nINTENT: the rule behind it"


def judge(prompt):
    assert set(prompt) == {"question", "answer", "context"}
    return '{"claims":[{"claim":"secret claim","verdict":"supported"},{"claim":"other","verdict":"no"}]}'


@pytest.fixture(scope="module")
def handbook(spark, tmp_path_factory):
    e = Engine(spark, f"{tmp_path_factory.mktemp('e')}/store", bag, "bag", llm, rewriter)
    e.index_handbook(sample.handbook(spark), sample.TITLE)
    return e


@pytest.fixture(scope="module")
def golden(tmp_path_factory):
    where = tmp_path_factory.mktemp("g")
    for n in ("a", "held", "real"):
        (where / f"{n}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in sample.golden()))
    return where


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def test_handbook_is_cut_by_sections(handbook):
    rows = handbook.store.read().orderBy("pos").collect()
    assert tuple(r.section_number for r in rows) == sample.SECTIONS
    one = {r.section_number: r for r in rows}
    assert one["2.3.1"].text.startswith("[harbour keeping, Ch.2 Lights And Signals, para 2.3.1, p.9] 2.3.1 Storm Flags\n")
    assert (one["APPENDIX 3.1"].page_start, one["APPENDIX 3.1"].page_end, one["1.1"].page_start) == (15, 15, 1)
    assert one["1.4"].heading == "Berth Charges" and one["1.4"].chapter_title == "Moorings And Berths"


def test_merge_again_changes_nothing(spark, handbook):
    name = handbook.store._latest()
    assert [(r.added, r.updated, r.deleted) for r in handbook.index_handbook(sample.handbook(spark), sample.TITLE).collect()] == [(0, 0, 0)]
    assert handbook.store._latest() == name


@pytest.mark.parametrize("mode", ["hybrid", "vector", "bm25"])
def test_retrieve(spark, handbook, mode):
    q = ask(spark, "What is said of the storing of lamp oil?").selectExpr("*", "cast(array() as array<string>) as rewrites", "cast(null as string) as intent")
    rows = handbook.retrieve(q, mode, 3).orderBy("rank").collect()
    # Words that most sections share weigh nothing, or less: only scores above 0 are results of the word arm.
    assert rows[0].section_number == "2.4" and [r["rank"] for r in rows] == list(range(1, 2 if mode == "bm25" else 4))
    assert "embedding" not in rows[0].asDict() and "pos" not in rows[0].asDict()
    assert handbook.retrieve(q, mode, 3, document_type="legislation").count() == 0
    assert handbook.retrieve(q, mode, 3, intent_weight=0.9).count() == len(rows)  # no intent: its weight does not matter
    with pytest.raises(ValueError):
        handbook.retrieve(q.withColumn("intent", F.lit("oil")), mode, 3, intent_weight=0.9)


def test_answer(spark, handbook, tmp_path):
    out = {r.query_id: r for r in handbook.answer(ask(spark, "What of the storing of lamp oil?", "And skis?", "And signal flags?"), log_to=f"{tmp_path}/log").collect()}
    assert (out[0].action, out[0].gate_outcome) == ("shown", "CITATIONS_VERIFIED") and "[Handbook, para 2.4, p.10]" in out[0].shown
    assert (out[1].action, out[1].citations) == ("refusal_shown", [])
    assert (out[2].action, out[2].shown, out[2].citations) == ("blocked_unverified", WITHHELD, []) and out[2].answer_chars == 36
    open_ = {r.query_id: r for r in handbook.answer(ask(spark, "And signal flags?"), override=True).collect()}
    assert open_[0].action == "shown_unverified_override" and "99.9" in open_[0].shown
    none = handbook.answer(ask(spark, "anything"), document_type="contracts").first()
    assert (none.action, none.shown, none.answer_chars, none.gate_outcome) == ("no_results", NO_RESULTS, 0, None)
    logged = spark.read.json(f"{tmp_path}/log").collect()
    assert len(logged) == 3 and {r.rewrite_status for r in logged} == {"live"} and all(r.intent_rewrite_sha256 for r in logged)
    text = "".join(p.read_text() for p in (tmp_path / "log").glob("part*"))
    assert "It is so" not in text and "lamp oil" not in text and '"id":' in text


def test_legislation_and_mixed_store(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/s", bag, "bag", llm)
    docs = spark.createDataFrame([("u", "An Act", "legislation", "PART I\nSection 1. Ferries are to run daily.\nSection 2. Fares are to be posted.")], "source string, title string, document_type string, text string")
    e.index_documents(docs)
    first = e.answer(ask(spark, "Are ferries to run daily?")).first()
    assert first.gate_outcome == "CITATIONS_UNVERIFIED"  # headers of acts are no locators of pages
    e.index_handbook(sample.handbook(spark), sample.TITLE)
    assert {r.document_type for r in e.store.read(columns=["document_type"]).distinct().collect()} == {"legislation", "handbook"}
    assert e.store.read(source="u").count() == 3
    assert e.store.read(ids=e.store.read(source="u").limit(1).select("chunk_id")).count() == 1
    q = ask(spark, "ferries").selectExpr("*", "cast(null as array<string>) as rewrites", "cast(null as string) as intent")
    assert e.retrieve(q, "bm25", 2).first().source == "u"


def test_empty_sync_keeps_the_store(spark, handbook, caplog):
    with caplog.at_level(logging.WARNING):
        assert handbook.index_documents(spark.createDataFrame([], "source string, title string, document_type string, text string"), reset=True).count() == 0
    assert "left as it is" in caplog.text and handbook.store.read().count() == len(sample.SECTIONS)


def test_missing_index_and_failing_arm(spark, tmp_path, caplog):
    e = Engine(spark, f"{tmp_path}/s", bag, "bag")
    with pytest.raises(ValueError, match="no store"):
        e.open()
    e.index_handbook(sample.handbook(spark), sample.TITLE)
    import shutil

    shutil.rmtree(f"{tmp_path}/s/words/{e.store._latest()}")
    q = ask(spark, "fog signals").selectExpr("*", "cast(null as array<string>) as rewrites", "cast(null as string) as intent")
    with caplog.at_level(logging.WARNING):
        assert e.retrieve(q, "hybrid", 3).count() == 3 and e.retrieve(q, "bm25", 3).count() == 0
    assert "no word index" in caplog.text

    def broken():
        raise RuntimeError("no model")

    bad = Engine(spark, f"{tmp_path}/s", broken, "bag")
    assert bad.retrieve(q, "vector", 3).count() == 0
    with pytest.raises(Exception, match="no model"):
        bad.retrieve(q, "vector", 3, strict=True).count()
    with pytest.raises(ValueError, match="made with"):
        Engine(spark, f"{tmp_path}/s", bag, "other").open()
    assert Store(spark, f"{tmp_path}/none").read() is None and Store(spark, f"{tmp_path}/none").lexical() is None
    Store(spark, f"{tmp_path}/none").clear()


def test_crash_between_table_and_pointer(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"{tmp_path}/s", bag, "bag")
    docs = lambda t: spark.createDataFrame([("u", "T", "legislation", t)], "source string, title string, document_type string, text string")
    e.index_documents(docs("first"))
    from tessera.operators import store as module

    monkeypatch.setattr(module, "write_segment", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        e.index_documents(docs("second"))
    assert [r.text for r in e.store.read().collect()] == ["[From: T] first"]


def test_matrix(spark, handbook, golden, tmp_path):
    sets = [("tuning", f"{golden}/a.jsonl"), ("held-out", f"{golden}/held.jsonl"), ("realistic", f"{golden}/real.jsonl")]
    out = matrix.run(handbook, sets, judge=judge, results=f"{tmp_path}/r.md", judge_dump=f"{tmp_path}/j.jsonl")
    assert out["canonical"] and out["generation_errors"] == 0
    whole = {(r["set"], r["mode"]): r for r in out["retrieval"] if r["type"] == "overall"}
    assert len(whole) == 12 and {m: r["strict_hits_6"] for (s, m), r in whole.items() if s == "tuning"} == {"hybrid": 7, "bm25": 7, "hybrid+rewrite": 7, "vector": 6}
    assert out["expansion"] == {"attempts": 8, "fallbacks": 0, "intent_present": 8, "intent_absent": 0}
    assert {(r["n"], r["refused"]) for r in out["refusal_accuracy"]} == {(1, 1)}
    assert [r["gate_outcome"] for r in out["refusal_detail"]] == ["REFUSAL"] * 3
    assert all((r["n_answers"], r["n_citations_unverified"], r["false_block_rate"]) == (7, 1, 0.142857) for r in out["answer_quality"])  # storm flags
    assert all(r["faithfulness"] == 0.5 and r["attempted"] == 7 for r in out["faithfulness"])
    text = (tmp_path / "r.md").read_text()
    assert "**7 of 7**" in text and "secret claim" not in text and "It is so" not in text and out["sets"]["tuning"]["sha256"] in text
    dumped = [json.loads(x) for x in (tmp_path / "j.jsonl").read_text().splitlines()]
    assert len(dumped) == 21 and dumped[0]["claims"][0] == {"claim": "secret claim", "verdict": "supported"}
    short = matrix.run(handbook, sets[:1], ("bm25",), 3, refusals=False, completeness=False, results=f"{tmp_path}/s.md")
    assert not short["canonical"] and short["expansion"]["attempts"] == 0 and short["answer_quality"] == []
    with pytest.raises(ValueError, match="question set"):
        matrix.run(handbook, sets[:1], ("bm25",), refusals=False, completeness=False, results=sets[0][1])


def test_failures_are_rows(spark, handbook, golden, tmp_path):
    calls = []

    def flaky(prompt):
        raise TimeoutError("slow")

    e = Engine(spark, handbook.path, bag, "bag", flaky, rewriter)
    out = matrix.run(e, [("a", f"{golden}/a.jsonl")], ("hybrid",), judge=judge, judge_sample=2, results=f"{tmp_path}/r.md")
    assert out["generation_errors"] == 8 and not out["canonical"] and out["refusal_detail"][0]["error"] == "TimeoutError: slow"
    assert out["refusal_accuracy"][0]["refused"] == 0 and out["answer_quality"][0]["n_errors"] == 7 and out["faithfulness"] == [] and calls == []
    (tmp_path / "twice.jsonl").write_text((json.dumps(sample.golden()[0]) + "\n") * 2)
    with pytest.raises(ValueError, match="twice"):
        matrix.run(handbook, [("t", f"{tmp_path}/twice.jsonl")], ("hybrid",), results=f"{tmp_path}/t.md")
    with pytest.raises(RuntimeError, match="slow"):
        e.answer(ask(spark, "lamp oil"))


def test_canonical():
    fine = {"answerable": {"heldout": 1, "realistic": 1}, "modes": evaluation.MODES, "distinct_files": True, "refusals_scored": True, "completeness_scored": True, "top_k": 6, "generation_errors": 0, "expansion_attempts": 1, "expansion_fallbacks": 0, "lexical_loaded": True, "lexical_needed": True, "judge": {"a": {"attempted": 1, "errors": 0}}}
    assert evaluation.is_canonical(fine)
    for k, v in {"answerable": {"heldout": 0, "realistic": 1}, "modes": ["hybrid"], "distinct_files": False, "refusals_scored": False, "completeness_scored": False, "top_k": 5, "generation_errors": 1, "expansion_attempts": 0, "expansion_fallbacks": 1, "lexical_loaded": False, "judge": {}}.items():
        assert not evaluation.is_canonical(fine | {k: v}), k
    assert evaluation.is_canonical(fine | {"lexical_loaded": False, "lexical_needed": False})
    assert not evaluation.is_canonical(fine | {"judge": {"a": {"attempted": 0, "errors": 0}}})


def test_results_path(tmp_path, caplog):
    (tmp_path / "set").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "set")
    with pytest.raises(ValueError):
        files.results_path(f"{tmp_path}/link", True, [f"{tmp_path}/set"])
    with pytest.raises(ValueError):
        files.results_path("eval/../eval/results.md", False, [])
    assert files.results_path(None, True, []) == "eval/results.md" and files.results_path(None, False, []) == "eval/results_partial.md"
    assert matrix.state({"git_dirty": True, "git_dirty_other": 0}) == "clean apart from this report" and matrix.state({"git_dirty": "unavailable", "git_dirty_other": 1}) == "unavailable"


def test_command_line(spark, golden, tmp_path, capsys):
    def reader(data):
        return data.decode().split("\f")

    pdf = tmp_path / "book.pdf"
    pdf.write_text("\f".join(sample.pages()))
    store = f"{tmp_path}/store"
    given = {"embedder": bag, "model": "bag", "llm": llm, "rewriter": rewriter, "judge": judge, "reader": reader}
    counts = main(["--store", store, "index", str(pdf), "--type", "handbook", "--reset"], spark, **given)
    assert [(r.added, r.updated, r.deleted) for r in counts] == [(15, 0, 0)]
    main(["--store", store, "query", "What of the taking of soundings?", "--verbose", "--log", f"{tmp_path}/log"], spark, **given)
    said = capsys.readouterr().out
    assert "[shown]" in said and "[Handbook, para 3.1, p.11]" in said and " 1. " in said
    out = main(["--store", store, "eval", "--golden", f"{golden}/a.jsonl", "--mode", "bm25", "--skip-refusals", "--skip-completeness", "-o", f"{tmp_path}/r.md"], spark, **given)
    assert {r["set"] for r in out["retrieval"]} == {"golden"} and (tmp_path / "r.md").exists()
    with pytest.raises(SystemExit):
        main([], spark)


def test_routes(spark, tmp_path):
    with pytest.raises(ValueError, match="reader"):
        files.load(spark, "x.pdf", "legislation")
    page = "<html><body><h1>Head</h1><p>Text</p></body></html>"
    got = files.load(spark, "http://example.org/a", "legislation", fetcher=lambda u: page).collect()
    assert [(r.source, r.title, r.text) for r in got] == [("http://example.org/a", "Head", "Head\nText")]

    def down(url):
        raise OSError("down")

    assert files.load(spark, "https://example.org/a", "legislation", fetcher=down).count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.pdf").write_text("Title here is self-\nmade\fsecond")
    (tmp_path / "d/b.pdf").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "d/c.htmx").write_text("<p>no</p>")
    (tmp_path / "d/d.html.bak").write_text("<p>no</p>")
    (tmp_path / "d/e.htm").write_text("<p>yes</p>")
    read = lambda b: b.decode().split("\f")
    got = files.load(spark, f"{tmp_path}/d", "legislation", read).collect()
    assert sorted((r.title, r.text) for r in got) == [("a.pdf", "Title here is selfmade\nsecond"), ("e.htm", "yes")]
    assert [r.text for r in files.load(spark, f"{tmp_path}/d/a.pdf", "legislation", read).collect()] == ["Title here is selfmade\nsecond"]
    assert files.load(spark, f"{tmp_path}/d/none.pdf", "legislation", read).count() == 0
    book = files.handbook_file(spark, f"{tmp_path}/d/a.pdf", read).first()
    assert [(s.page_number, s.char_start) for s in book.page_map] == [(1, 0), (2, 23)]
    assert files.handbook_file(spark, f"{tmp_path}/d/b.pdf", read).count() == 0


def test_audit_path(monkeypatch, spark, tmp_path):
    monkeypatch.setenv("AUDIT_LOG_PATH", f"{tmp_path}/env")
    assert audit.path("x") == "x" and audit.path() == f"{tmp_path}/env" and not audit.keeps_texts()
    monkeypatch.delenv("AUDIT_LOG_PATH")
    assert audit.path() == audit.DEFAULT_PATH
    (tmp_path / "file").write_text("x")
    assert not audit.append(spark.range(1), f"{tmp_path}/file/log")


def test_a_failed_question_may_be_asked_again(spark, handbook, tmp_path):
    seen = tmp_path / "seen"

    def flaky(prompt):
        with open(seen, "a") as f:
            f.write("x")
        if seen.read_text() == "x":
            raise TimeoutError("slow")
        return llm(prompt)

    e = Engine(spark, handbook.path, bag, "bag", flaky, rewriter, answers=f"{tmp_path}/answers")
    with pytest.raises(RuntimeError, match="slow"):
        e.answer(ask(spark, "What of the storing of lamp oil?"))
    assert [e.answer(ask(spark, "What of the storing of lamp oil?")).first().action for _ in range(2)] == ["shown"] * 2
    assert seen.read_text() == "xx"  # the third time it is read from the table
