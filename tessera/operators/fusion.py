"""Hybrid retrieval: sub-queries with weights, arms, weighted reciprocal-rank fusion, context."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold, strip
from tessera.sources.shared import held

log = logging.getLogger(__name__)
#: Rank constant, least candidates of a list, default results, rewrite budget, intent weight and its bound (fixed values).
RRF_K, POOL, TOP_K, REWRITE_WEIGHT, INTENT_WEIGHT, MOST_INTENT = 60, 12, 6, 0.5, 0.25, 0.5
ARMS = ("vector", "bm25")
MODES = ("hybrid", *ARMS)
NO_CONTEXT = "No relevant documents found."


def check(mode: str, top_k: int, intent_weight: float = INTENT_WEIGHT) -> None:
    """Reject bad parameters before anything is read."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if not 0 <= intent_weight <= MOST_INTENT:
        raise ValueError(f"the intent weight must be from 0 to {MOST_INTENT}")


def sub_queries(questions: DataFrame, intent_weight: float = INTENT_WEIGHT) -> DataFrame:
    """(query_id, ord, kind, text, weight) of (query_id, question, rewrites array, intent).

    The question comes first, as it stands; rewrites are stripped, and dropped if blank or equal to anything before
    without case; they share one budget. The intent comes last, unless it is blank, equal to a kept one or of weight 0.
    """
    rewrites = F.transform(F.coalesce("rewrites", F.array().cast("array<string>")), lambda t: strip(t))
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("question").alias("text"))),
        F.transform(rewrites, lambda t: F.struct(F.lit(1).alias("kind"), t.alias("text"))),
        F.array(F.struct(F.lit(2).alias("kind"), strip(F.col("intent")).alias("text"))) if intent_weight > 0 else F.array().cast("array<struct<kind:int,text:string>>"),
    )
    rows = questions.select("query_id", F.posexplode(parts).alias("pos", "p")).select("query_id", "pos", "p.*").where("kind = 0 or text <> ''")
    first = F.row_number().over(Window.partitionBy("query_id", fold(strip(F.col("text")))).orderBy("pos"))
    rows = rows.withColumn("n", first).where("n = 1")
    of_question = Window.partitionBy("query_id")
    n = F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(of_question)
    weight = F.when(F.col("kind") == 0, 1.0).when(F.col("kind") == 1, F.lit(REWRITE_WEIGHT) / n).otherwise(intent_weight)
    order = (F.row_number().over(of_question.orderBy("pos")) - 1).alias("ord")
    kind = F.element_at(F.array(*map(F.lit, ("original", "rewrite", "intent"))), F.col("kind") + 1)
    return rows.select("query_id", order, kind.alias("kind"), "text", weight.alias("weight"))


def rrf(lists: DataFrame, key: str = "doc_id", top_k: int | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """(by, key, score, rank) of ranked lists (by, list_ord, weight, key, rank).

    Scores are sums of weight / (60 + rank); ties go to what comes first in the lists, in their order.
    """
    fused = lists.groupBy(*by, key).agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_ord", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "first", key))
    out = fused.select(*by, key, "score", rank.alias("rank"))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def ranked_lists(subs: DataFrame, arms: dict[str, Callable[[DataFrame, int], DataFrame | None]], depth: int, key: str = "doc_id") -> DataFrame | None:
    """(query_id, arm, kind, list_ord, weight, key, rank): what each arm finds for each sub-query, vector lists before lexical ones.

    An arm takes (sub_id, query_id, text) rows and a depth and gives (sub_id, key, rank). An absent arm (no index) leaves
    the others; with none left there is nothing.
    """
    subs = subs.withColumn("sub_id", F.concat_ws(":", "query_id", "ord"))
    lists = []
    for place, name in enumerate(ARMS):
        found = arms[name](subs, depth) if name in arms else None
        if found is not None:
            own = found.select("sub_id", key, "rank").join(subs.select("sub_id", "query_id", "ord", "kind", "weight"), "sub_id")
            lists.append(own.select("query_id", F.lit(name).alias("arm"), "kind", (F.lit(place * 1000) + F.col("ord")).alias("list_ord"), "weight", key, "rank"))
    return reduce(DataFrame.unionByName, lists) if lists else None


@dataclass(frozen=True)
class Plan:
    """A way to fuse the same lists: a mode, with rewrites and intent or without, and the intent's weight."""

    name: str
    mode: str = "hybrid"
    rewrites: bool = True
    intent_weight: float = INTENT_WEIGHT

    def arms(self) -> tuple[str, ...]:
        return ARMS if self.mode == "hybrid" else (self.mode,)


def fused(lists: DataFrame, plans: Sequence[Plan], top_k: int = TOP_K, key: str = "doc_id") -> DataFrame:
    """(plan, query_id, key, score, rank): the lists, which are made once, fused by each of a few plans."""
    rows = [(p.name, list(p.arms()), ["original", "rewrite", "intent"] if p.rewrites else ["original"], float(p.intent_weight)) for p in plans]
    table = lists.sparkSession.createDataFrame(rows, "plan string, arms array<string>, kinds array<string>, intent_weight double")
    every = lists.join(F.broadcast(table), F.array_contains("arms", F.col("arm")) & F.array_contains("kinds", F.col("kind")))  # a row for each plan
    own = every.withColumn("weight", F.when(F.col("kind") == "intent", F.col("intent_weight")).otherwise(F.col("weight"))).where("weight > 0")
    return rrf(own, key, top_k, ("plan", "query_id"))


def retrieve(subs: DataFrame, arms: dict[str, Callable[[DataFrame, int], DataFrame | None]], mode: str = "hybrid", top_k: int = TOP_K, key: str = "doc_id") -> DataFrame:
    """Fused results of sub-queries over the arms that a mode needs; see ranked_lists."""
    check(mode, top_k)
    lists = ranked_lists(subs, {n: a for n, a in arms.items() if mode in ("hybrid", n)}, max(POOL, top_k), key)
    if lists is None:
        return subs.limit(0).select("query_id", F.lit(None).cast("long").alias(key), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return rrf(lists, key, top_k)


def tolerant(arm: Callable[[DataFrame, int], DataFrame], name: str) -> Callable[[DataFrame, int], DataFrame]:
    """The arm, run at once; where it fails it gives no rows, and a warning."""

    def run(subs: DataFrame, depth: int) -> DataFrame | None:
        try:
            found = held(arm(subs, depth))
        except Exception as e:  # noqa: BLE001  one arm must not fail the others
            log.warning("the %s arm failed: %s", name, e)
            return None
        return found

    return run


def page_text(start: Column, end: Column) -> Column:
    """'' without pages, p.N for one, pp.lo–hi for a range."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    return F.when(lo.isNull(), "").when(lo == hi, F.concat(F.lit("p."), lo.cast("string"))).otherwise(F.concat(F.lit("pp."), lo.cast("string"), F.lit("–"), hi.cast("string")))


def locator(section: Column) -> Column:
    """APPENDIX sections stand as they are, others as para X; none for an empty one."""
    return F.when(F.coalesce(section, F.lit("")) == "", F.lit(None)).when(section.startswith("APPENDIX"), section).otherwise(F.concat(F.lit("para "), section))


def handbook_header(section: Column, start: Column, end: Column) -> Column:
    pages = F.when(start != end, F.concat(F.lit("pp."), start.cast("string"), F.lit("–"), end.cast("string"))).when(start.isNotNull(), F.concat(F.lit("p."), start.cast("string")))
    return F.concat(F.lit("["), F.concat_ws(", ", F.lit("Handbook"), locator(section), pages), F.lit("]"))


def generic_header(rank: Column, title: Column, section: Column, source: Column) -> Column:
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    of = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", Section "), section)).otherwise("")
    return F.concat(F.lit("[Source "), rank.cast("string"), F.lit(": "), known(title), of, F.lit(" | "), known(source), F.lit("]"))


def context(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, context): header, text and rule of each result (query_id, rank, header, text) in rank order."""
    part = F.concat("header", F.lit("\n"), "text", F.lit("\n---"))
    made = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    return questions.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce(joined, F.lit(NO_CONTEXT)).alias("context"))
