"""The command line: index, query and eval. Models come from a module of the caller's: --models package.module, which may
define embedder, model, llm, rewriter, judge and reader; without it the stand-in embedder works alone."""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from pyspark.sql import SparkSession

from tessera.operators import evaluation, fusion
from tessera.plans import matrix
from tessera.plans.engine import Engine

#: The set that parameters were tuned on; another one under --golden is called so.
GOLDEN = "eval/golden_set.jsonl"
KINDS = ("handbook", "legislation", "case_law", "contracts")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Index documents, answer questions from them, evaluate retrieval and answers.")
    top.add_argument("--store", default="store", help="folder of the chunk store")
    top.add_argument("--models", help="module with embedder, model, llm, rewriter, judge and reader")
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="load, chunk and merge a file, folder or URL")
    index.add_argument("path")
    index.add_argument("--type", choices=KINDS, default="handbook")
    index.add_argument("--reset", action="store_true", help="clear the store first, once the new chunks are made")
    query = sub.add_parser("query", help="answer a question")
    query.add_argument("question")
    query.add_argument("--top-k", type=int, default=fusion.TOP_K)
    query.add_argument("--type", choices=KINDS)
    query.add_argument("--verbose", action="store_true", help="list the retrieved chunks")
    query.add_argument("--show-unverified", action="store_true", help="show a draft that the gate withholds")
    query.add_argument("--no-rewrite", action="store_true", help="search for the question as it stands")
    query.add_argument("--log", help="folder of the audit log; else AUDIT_LOG_PATH, or the default")
    ev = sub.add_parser("eval", help="evaluate question sets")
    ev.add_argument("--golden", default=GOLDEN, help="the set that parameters were tuned on, by default, or another")
    ev.add_argument("--heldout")
    ev.add_argument("--realistic")
    ev.add_argument("--mode", choices=(*evaluation.MODES, "all"), default="all")
    ev.add_argument("--top-k", type=int, default=fusion.TOP_K)
    ev.add_argument("--skip-refusals", action="store_true")
    ev.add_argument("--skip-completeness", action="store_true")
    ev.add_argument("--judge", action="store_true")
    ev.add_argument("--judge-sample", type=int)
    ev.add_argument("--judge-dump", default="eval/judge_review.jsonl")
    ev.add_argument("-o", "--results")
    return top


def show(engine: Engine, args: argparse.Namespace) -> None:
    """Answer one question and print what may be shown, with its citations, and on request where it looked."""
    asked = engine.spark.createDataFrame([(1, args.question)], "query_id long, question string")
    got = engine.answer(asked, args.top_k, args.show_unverified, args.log or "", args.type, rewrite=not args.no_rewrite).first()
    print(f"[{got['action']}] {got['shown']}")
    for c in got["citations"]:
        print(f"  - {c['raw']}")
    if args.verbose or got["action"] in ("blocked_unverified", "shown_unverified_override"):
        plain = asked.selectExpr("*", "cast(array() as array<string>) as rewrites", "cast(null as string) as intent")
        for r in engine.retrieve(plain, top_k=args.top_k, document_type=args.type).orderBy("rank").collect():
            print(f"  {r['rank']:>2}. {r['score']:.5f}  {r['section_number'] or '—'}  p.{r['page_start'] or '?'}  [{r['document_type']}]  {r['source']}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **given: Any) -> Any:
    """Run a command; `given` are models that stand before those of the module."""
    args = parser().parse_args(argv)
    found = importlib.import_module(args.models) if args.models else None
    models = {n: getattr(found, n) for n in ("embedder", "model", "llm", "rewriter", "judge", "reader") if hasattr(found, n)} | given
    judge = models.pop("judge", None)
    engine = Engine(spark or SparkSession.builder.appName("tessera").getOrCreate(), args.store, **models)
    if args.command == "index":
        counts = engine.index(args.path, args.type, args.reset).collect()
        print(f"{len(counts)} source(s): " + ", ".join(f"{sum(r[c] for r in counts)} {c}" for c in ("added", "updated", "deleted")))
        return counts
    if args.command == "query":
        return show(engine, args)
    sets = [(n, p) for n, p in (("tuning" if args.golden == GOLDEN else "golden", args.golden), ("held-out", args.heldout), ("realistic", args.realistic)) if p]
    modes = evaluation.MODES if args.mode == "all" else (args.mode,)
    out = matrix.run(engine, sets, modes, args.top_k, not args.skip_refusals, not args.skip_completeness, judge if args.judge else None, args.judge_sample, args.results, args.judge_dump if args.judge else None)
    print(matrix.report(out))
    return out


if __name__ == "__main__":
    main()
