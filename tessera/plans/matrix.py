"""Evaluation of question sets under retrieval modes, with answer passes, provenance and a report."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, expansion, fusion
from tessera.operators.grounding import REFUSAL, is_caveat
from tessera.plans.engine import Engine
from tessera.sources import files
from tessera.sources.shared import held

#: Tries of a generation, and what cannot be told.
ATTEMPTS, UNKNOWN = 3, "unavailable"
IN_CORPUS, REFUSALS = ("direct", "exact_token"), ("refusal",)
MATCHING = "strict: equal section numbers; related: equal, or one nests in the other"


def golden_sets(engine: Engine, sets: Sequence[tuple[str, str]]) -> DataFrame:
    """(set, query_id, question, type, expected_sections) of labelled files; query_id is label:line."""
    own = [files.golden_set(engine.spark, path).select(F.lit(label).alias("set"), F.concat(F.lit(f"{label}:"), F.col("query_id").cast("string")).alias("query_id"), "question", "type", "expected_sections") for label, path in sets]
    return reduce(DataFrame.unionByName, own)


def expanded(golden: DataFrame, engine: Engine, enabled: bool = True) -> DataFrame:
    """golden with rewrites, intent and status; each distinct question is expanded once."""
    once = expansion.expand(golden.select("question").distinct(), engine.rewriter, enabled=enabled, answers=engine.table())
    return golden.join(once, "question")


def first_ranks(engine: Engine, asked: DataFrame, modes: Sequence[str], top_k: int = fusion.TOP_K) -> DataFrame:
    """(mode, set, query_id, type, strict_rank, related_rank) of the answerable questions under each mode."""
    own = asked.where(F.col("type").isin(*IN_CORPUS))
    plans = [fusion.Plan(mode, mode.split("+")[0], mode.endswith("+rewrite")) for mode in modes]
    found = held(engine.retrieve_by(own, plans, top_k).select("plan", "query_id", "rank", "section_number"))  # one search of each arm for all modes
    each = own.select("set", "query_id", "type", "expected_sections").join(F.broadcast(own.sparkSession.createDataFrame([(m,) for m in modes], "mode string")))  # a few modes
    ranks = evaluation.first_match(each, found.withColumnRenamed("plan", "mode"), top_k)
    return ranks.select("mode", "set", "query_id", "type", "strict_rank", "related_rank")


def answers(engine: Engine, asked: DataFrame, types: Sequence[str], top_k: int = fusion.TOP_K) -> DataFrame:
    """Drafts of the questions of some types, each generated once; equal questions of one set are an error."""
    own = asked.where(F.col("type").isin(*types))
    twice = own.groupBy("set", "question").count().where("count > 1").first()
    if twice:
        raise ValueError(f"a question is twice in set {twice['set']}: {twice['question']!r}")
    found = held(engine.retrieve(own, "hybrid", top_k, strict=True))
    return held(own.select("set", "query_id", "type").join(engine.generate(own, found, ATTEMPTS, every=True), "query_id"))


def _size(c: str) -> F.Column:
    return F.when(F.col(c).isNull(), 0).otherwise(F.size(c))


def refusal_detail(drafts: DataFrame) -> DataFrame:
    """(set, query_id, question, error, is_caveat, gate_outcome, n_grounded, n_citations) of refusal questions, no answers."""
    caveat = F.when(F.col("error").isNull(), is_caveat(F.col("answer")))
    return drafts.where(F.col("type").isin(*REFUSALS)).select("set", "query_id", "question", "error", caveat.alias("is_caveat"), "gate_outcome", _size("grounded").alias("n_grounded"), _size("citations").alias("n_citations"))


def judged(engine: Engine, drafts: DataFrame, judge: Callable[[dict[str, str]], str], sample: int | None = None, seed: int = 0) -> DataFrame:
    """(set, query_id, question, and the judge's record) of answered, not refused questions of the corpus, or of a seeded
    sample of each set's."""
    if sample is not None and sample < 0:
        raise ValueError("the sample must not be negative")
    own = drafts.where(F.col("type").isin(*IN_CORPUS) & F.col("error").isNull() & (F.col("gate_outcome") != REFUSAL))
    if sample is not None:
        own = evaluation.seeded_rows(own, ["query_id"], sample, seed, by=["set"]).drop("place")

    prompt = F.to_json(F.struct("question", "answer", "context"))
    said = engine.table().ask(own.withColumn("prompt_", prompt).drop("error").withColumnRenamed("answer", "drafted"), "prompt_", lambda t: judge(json.loads(t)), "judge")
    return held(said.select("set", "query_id", "question", evaluation.judge_record(F.col("answer")).alias("r")).select("set", "query_id", "question", "r.*"))


def provenance(engine: Engine, exclude: Sequence[str] = (), generation_model: str = UNKNOWN) -> dict[str, Any]:
    """What code, index and models a run used; what cannot be told is 'unavailable'."""
    here = os.path.dirname(os.path.abspath(__file__))

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, check=True, cwd=here).stdout  # noqa: S603, S607
        except (OSError, subprocess.CalledProcessError):
            return None

    sha, state = git("rev-parse", "--short", "HEAD"), git("status", "--porcelain")
    dirty = None if state is None else [line[3:].split(" -> ")[-1] for line in state.splitlines() if line]
    skip = {os.path.normpath(p) for p in exclude}
    try:
        chunks: Any = engine.open().chunks.count()
    except Exception:  # noqa: BLE001  a report can be made without a store
        chunks = UNKNOWN
    return {
        "git_sha": sha.strip() if sha else UNKNOWN, "git_dirty": UNKNOWN if dirty is None else bool(dirty), "git_dirty_other": UNKNOWN if dirty is None else sum(os.path.normpath(p) not in skip for p in dirty),
        "chunk_count": chunks, "embedding_model": engine.model, "generation_model": generation_model, "matching": MATCHING,
    }


def run(
    engine: Engine, sets: Sequence[tuple[str, str]], modes: Sequence[str] = evaluation.MODES, top_k: int = fusion.TOP_K, refusals: bool = True, completeness: bool = True,
    judge: Callable[[dict[str, str]], str] | None = None, judge_sample: int | None = None, results: str | None = None, judge_dump: str | None = None, own_retrieval: bool = False,
) -> dict[str, Any]:
    """Evaluate labelled sets [(label, path)] under modes; write the report and return what it says.

    Answers are generated only for the passes that are on, once a question; with both answer passes off nothing is expanded
    either. A set is held out, or a realistic one, by its label. The judge's claims go to judge_dump only. own_retrieval says
    that engine.retrieve is the caller's, who answers for its index.
    """
    if bad := [m for m in modes if m not in evaluation.MODES]:
        raise ValueError(f"unknown modes {bad}")
    fusion.check("hybrid", top_k)
    engine.said = None  # answers of this run
    asked = held(expanded(golden_sets(engine, sets), engine, enabled=refusals or completeness))
    ranks = held(first_ranks(engine, asked, modes, top_k))
    out: dict[str, Any] = {"sets": {}, "modes": list(modes), "top_k": top_k, "refusals": refusals, "completeness": completeness, "judge": judge is not None}
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  a few rows a set
    out["retrieval"] = rows(evaluation.hit_metrics(ranks, ["set", "mode", "type"], top_k, also_total="type").orderBy("set", "mode", "type"))
    out["misses"] = rows(ranks.where("strict_rank is null").groupBy("set", "mode").agg(F.array_sort(F.collect_list("query_id")).alias("questions")).orderBy("set", "mode"))
    counted = {r["set"]: r for r in rows(asked.groupBy("set").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("type") == t, 1).otherwise(0)).alias(t) for t in files.TYPES]))}
    out["sets"] = {label: {"path": path, "sha256": files.fingerprint(engine.spark, path), "counts": counted.get(label, {"n": 0})} for label, path in sets}
    told = asked.where("status <> 'disabled'")
    out["expansion"] = rows(evaluation.expansion_counts(told.select("question", "status", "intent")))[0]
    types = (REFUSALS if refusals else ()) + (IN_CORPUS if completeness or judge else ())
    out["generation_errors"] = 0
    out |= {"refusal_accuracy": [], "refusal_detail": [], "answer_quality": [], "faithfulness": []}
    judge_ok: dict[str, dict[str, int]] = {}
    if types:
        drafts = answers(engine, asked, types, top_k)
        out["generation_errors"] = drafts.where("error is not null").count()
        if refusals:
            detail = refusal_detail(drafts)
            out["refusal_detail"] = rows(detail.orderBy("set", "query_id"))
            out["refusal_accuracy"] = rows(evaluation.refusal_accuracy(detail, ["set"]).orderBy("set"))
        if completeness:
            quality = drafts.where(F.col("type").isin(*IN_CORPUS)).withColumns({"n_citations": _size("citations"), "n_grounded": _size("grounded")})
            out["answer_quality"] = rows(evaluation.completeness(quality, ["set"]).orderBy("set"))
        if judge:
            records = judged(engine, drafts, judge, judge_sample)
            out["faithfulness"] = rows(evaluation.judge_summary(records, ["set"]).orderBy("set"))
            judge_ok = {label: {"attempted": 0, "errors": 0} for label, _ in sets}
            judge_ok |= {r["set"]: {"attempted": r["attempted"], "errors": r["errors"]} for r in rows(records.groupBy("set").agg(F.count("*").alias("attempted"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("errors")))}
            if judge_dump:
                files.write_report("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows(records.orderBy("set", "query_id"))), judge_dump)
    answerable = {kind: sum(r["n"] for r in out["retrieval"] if r["mode"] == "hybrid" and r["type"] == "overall" and mark in r["set"]) for kind, mark in (("heldout", "held-out"), ("realistic", "realistic"))}
    paths = [p for _, p in sets]
    out["word_index_loaded"] = engine.opened is not None and engine.opened.words is not None
    out["canonical"] = evaluation.is_canonical({
        "answerable": answerable, "modes": modes, "distinct_files": not any(files.same_file(a, b) for k, a in enumerate(paths) for b in paths[k + 1 :]), "refusals_scored": refusals, "completeness_scored": completeness, "top_k": top_k,
        "generation_errors": out["generation_errors"], "expansion_attempts": out["expansion"]["attempts"], "expansion_fallbacks": out["expansion"]["fallbacks"], "lexical_loaded": out["word_index_loaded"], "lexical_needed": not own_retrieval, "judge": judge_ok,
    })
    out["results_path"] = files.results_path(results, out["canonical"], paths)
    out["provenance"] = provenance(engine, (out["results_path"],))
    files.write_report(report(out), out["results_path"])
    return out


def run_single(engine: Engine, path: str, top_k: int = fusion.TOP_K, results: str | None = None) -> dict[str, Any]:
    """One set under hybrid retrieval with its questions as they stand: the short form of run()."""
    return run(engine, [("golden", path)], ("hybrid",), top_k, refusals=False, completeness=False, results=results)


def _cell(x: Any) -> str:
    return "–" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def _table(head: Sequence[str], body: Sequence[Sequence[Any]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in body), ""]


def state(p: dict[str, Any]) -> str:
    """How clean the code of a run was."""
    if not isinstance(p["git_dirty"], bool):
        return str(p["git_dirty"])
    if not p["git_dirty"]:
        return "clean"
    other = p["git_dirty_other"]
    return "dirty" if not isinstance(other, int) else "clean apart from this report" if other == 0 else f"dirty: {other} file(s) beyond this report"


def report(r: dict[str, Any]) -> str:
    """The run as Markdown: counts, rates and question numbers, never a text of an answer, a claim or a chunk."""
    p, e, k = r["provenance"], r["expansion"], r["top_k"]
    on = lambda x: "on" if x else "off"
    out = ["# Evaluation", "", f"- date: {datetime.now(UTC).isoformat(timespec='seconds')}", f"- results a question: {k}", f"- modes: {', '.join(r['modes'])}", f"- canonical: {r['canonical']}", ""]
    out += ["## Provenance", "", f"- code: {p['git_sha']} ({state(p)})", f"- chunks: {p['chunk_count']}", f"- embedding model: {p['embedding_model']}", f"- generation model: {p['generation_model']}", f"- matching: {p['matching']}"]
    out += [f"- mean reciprocal rank: cut at {k}, a miss counts 0", f"- passes: refusals {on(r['refusals'])}, completeness {on(r['completeness'])}, judge {on(r['judge'])}", f"- expansions: {e['attempts']} asked, {e['fallbacks']} fell back, {e['intent_present']} with an intent", f"- word index loaded: {r['word_index_loaded']}", f"- generation errors: {r['generation_errors']}", ""]
    for label, s in r["sets"].items():
        out.append(f"- {label}: {s['path']}, SHA-256 {s['sha256']}, " + ", ".join(f"{n} {t}" for t, n in s["counts"].items() if t not in ("set", "n")))
    whole = [x for x in r["retrieval"] if x["type"] == "overall"]
    first = next((x for x in whole if "held-out" in x["set"] and x["mode"] == "hybrid"), next((x for x in whole if x["mode"] == "hybrid"), None))
    out += ["", "## Headline", ""]
    if first and "strict_hits_6" in first:
        low, high = evaluation.wilson_value(first["strict_hits_6"], first["n"])
        out += [f"Strict hits at 6, hybrid, {first['set']}: **{first['strict_hits_6']} of {first['n']}** (95 % interval {low:.3f} to {high:.3f}).", ""]
    else:
        out += ["None: it needs hybrid retrieval of six results or more.", ""]
    cuts = [c for c in evaluation.CUTS if c <= k]
    for label in r["sets"]:
        out += [f"## {label}", ""]
        own = [x for x in r["retrieval"] if x["set"] == label]
        out += _table(["mode", "type", "n", *(f"strict@{c}" for c in cuts), *(f"related@{c}" for c in cuts), "strict MRR", "related MRR"], [[x["mode"], x["type"], x["n"], *(x[f"{m}_rate_{c}"] for m in ("strict", "related") for c in cuts), x["strict_mrr"], x["related_mrr"]] for x in own])
        for m in r["misses"]:
            if m["set"] == label:
                out.append(f"- strict misses under {m['mode']}: {', '.join(m['questions'])}")
        out.append("")
        for title, key, skip in (("Refusals", "refusal_accuracy", ()), ("Answers", "answer_quality", ()), ("Faithfulness (experimental)", "faithfulness", ())):
            for x in r[key]:
                if x["set"] == label:
                    out += [f"### {title}", "", *(f"- {n}: {_cell(v)}" for n, v in x.items() if n != "set" and n not in skip), ""]
        detail = [x for x in r["refusal_detail"] if x["set"] == label]
        if detail:
            out += _table(["refusal question", "outcome", "caveat", "grounded", "citations", "error"], [[x["question"], x["gate_outcome"], x["is_caveat"], x["n_grounded"], x["n_citations"], x["error"]] for x in detail])
    return "\n".join(out) + "\n"
