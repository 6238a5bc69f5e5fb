"""Retrieval and answer metrics over batches of questions."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.grounding import CITATION, PARTIAL, REFUSAL, UNVERIFIED, VERIFIED, is_caveat, sections_related

#: Cut-offs, the normal quantile, abbreviations that end no sentence, most failures of a judge.
CUTS, Z, MOST_FAILURES = (1, 3, 6), 1.96, 0.20
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "cf.", "viz.", "approx.", "vs.", "paras.", "para.", "pp.", "p.", "ss.", "s.", "no.", "art.", "ch.", "sec.")
MODES = ("hybrid", "vector", "bm25", "hybrid+rewrite")


def first_match(golden: DataFrame, results: DataFrame, top_k: int) -> DataFrame:
    """golden (query_id, ..., expected_sections) with strict_rank and related_rank, null for a miss.

    results holds (query_id, rank, section_number). Strict is equality, empty sections never match; related is nesting
    either way. Other columns shared by both sides (such as set and mode) join them too.
    """
    keys = [c for c in golden.columns if c in results.columns]
    want = golden.select(*keys, F.explode("expected_sections").alias("want_"))
    own = results.where(F.col("rank") <= top_k).select(*keys, "rank", F.coalesce("section_number", F.lit("")).alias("have_"))
    met = want.join(own, keys).where(sections_related(F.col("want_"), F.col("have_")))
    best = met.groupBy(*keys).agg(F.min(F.when(F.col("want_") == F.col("have_"), F.col("rank"))).alias("strict_rank"), F.min("rank").alias("related_rank"))
    return golden.join(best, keys, "left")


def hit_metrics(ranks: DataFrame, by: Sequence[str], top_k: int = 6, also_total: str | None = None) -> DataFrame:
    """Per group the questions, hits and rates at each cut up to top_k, and mean reciprocal rank, strict and related.

    With also_total, one of `by` is also rolled up; the rolled-up rows have 'overall' there.
    """
    aggs: list[Column] = [F.count("*").alias("n")]
    for kind in ("strict", "related"):
        r = F.col(f"{kind}_rank")
        for k in CUTS:
            if k <= top_k:
                hit = F.sum(F.when(r <= k, 1).otherwise(0))
                aggs += [hit.alias(f"{kind}_hits_{k}"), F.round(hit / F.count("*"), 6).alias(f"{kind}_rate_{k}")]
        aggs.append(F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias(f"{kind}_mrr"))
    if also_total is None:
        return ranks.groupBy(*by).agg(*aggs)
    sets = [list(by), [b for b in by if b != also_total]]
    out = ranks.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(*aggs)
    return out.withColumn(also_total, F.coalesce(also_total, F.lit("overall")))


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of a share, cut to 0 and 1; (0, 0) without cases."""
    p = hits / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = (z / d) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    zero = lambda c: F.when(n == 0, 0.0).otherwise(c)
    return zero(F.greatest(F.lit(0.0), centre - half)), zero(F.least(F.lit(1.0), centre + half))


def sentences(answer: Column) -> Column:
    """The sentences of a text: lines, cut after . ! ? before a capital, a quote or a bracketed span.

    Bracketed spans count as one token; listed abbreviations end no sentence.
    """
    text = F.coalesce(answer, F.lit(""))
    spans = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]"), F.lit(0))
    masked = F.regexp_replace(text, r"\[[^\]]*\]", "\0")
    for a in ABBREVIATIONS:
        held = "\x01".join(f"${k + 1}" for k in range(a.count("."))) + "\x01"
        masked = F.regexp_replace(masked, r"(?i)\b" + "".join(f"({p})\\." for p in a.split(".")[:-1]), held)
    cut = F.regexp_replace(masked, r"([.!?])\s+(?=[A-Z\"“\x00])", "$1\n")
    parts = F.filter(F.transform(F.split(cut, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.replace(x, F.lit("\x01"), F.lit(".")))
    masks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\0"), F.lit("")))
    # The k-th sentence's spans follow those of the sentences before it.
    begin = lambda k: F.aggregate(F.slice(plain, F.lit(1), k), F.lit(0), lambda a, x: a + masks(x))

    def back(x: Column, k: Column) -> Column:
        bits = F.split(x, "\0", -1)
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(bits), F.lit(2))), F.element_at(bits, 1), lambda a, i: F.when(i <= F.size(bits), F.concat(a, F.element_at(spans, begin(k) + i - 1), F.element_at(bits, F.least(i, F.size(bits))))).otherwise(a))

    return F.transform(plain, back)


def completeness(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: answers with a result, false refusals and blocks, sentence coverage, grounded citations, outcome counts.

    answers holds answer, gate_outcome, n_citations, n_grounded and error. Rows with an error count only as errors; coverage
    leaves refusals and the caveat sentence out; shares without cases are null.
    """
    ok = F.col("error").isNull()
    own = answers.withColumn("told_", F.filter(sentences(F.col("answer")), lambda s: ~is_caveat(s)))
    counted = ok & (F.col("gate_outcome") != REFUSAL)
    n, cited = F.when(counted, F.size("told_")), F.when(counted, F.size(F.filter("told_", lambda s: s.rlike(CITATION))))
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    with_result = number(ok)
    cites = F.coalesce(F.sum(F.when(ok, F.col("n_citations"))), F.lit(0))
    out = [with_result.alias("n_answers"), number(~ok).alias("n_errors"), share(number(ok & (F.col("gate_outcome") == REFUSAL)), with_result).alias("false_refusal_rate"), share(number(ok & (F.col("gate_outcome") == UNVERIFIED)), with_result).alias("false_block_rate"), share(F.sum(cited), F.coalesce(F.sum(n), F.lit(0))).alias("coverage"), share(F.sum(F.when(ok, F.col("n_grounded"))), cites).alias("grounded_rate")]
    out += [number(ok & (F.col("gate_outcome") == o)).alias(f"n_{o.lower()}") for o in (REFUSAL, VERIFIED, PARTIAL, UNVERIFIED)]
    return own.groupBy(*by).agg(*out)


_JUDGED = "struct<claims:array<struct<claim:string,verdict:string>>>"


def judge_record(raw: Column) -> Column:
    """A judge's answer as struct(ok, error_type, n_claims, supported, unsupported, unclear, faithfulness, claims).

    Null is a failed call (api); what holds no JSON object with a list of claims that all have a text is a parse error.
    Verdicts other than supported and unsupported are unclear; without claims there is no faithfulness.
    """
    bare = F.regexp_replace(raw, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    claims = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), _JUDGED)["claims"]
    good = F.coalesce(claims.isNotNull() & F.forall(claims, lambda c: c["claim"].isNotNull() & c["verdict"].isNotNull()), F.lit(False))
    verdict = lambda v: F.size(F.filter(claims, lambda c: F.lower(F.trim(c["verdict"])) == v))
    n, yes, no = F.size(claims), verdict("supported"), verdict("unsupported")
    zero = lambda c: F.when(good, c).otherwise(0)
    return F.struct(
        good.alias("ok"), F.when(raw.isNull(), "api").when(~good, "parse").alias("error_type"), zero(n).alias("n_claims"), zero(yes).alias("supported"),
        zero(no).alias("unsupported"), zero(n - yes - no).alias("unclear"), F.when(good & (n > 0), yes / n).alias("faithfulness"),
        F.when(good, claims).alias("claims"),
    )


def judge_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: attempted, failure_rate, zero_claim, mean faithfulness, which is null when too many failed."""
    failed = F.round(F.sum(F.when(F.col("ok"), 0).otherwise(1)) / F.count("*"), 6)
    mean = F.round(F.avg(F.when(F.col("ok") & (F.col("n_claims") > 0), F.col("faithfulness"))), 6)
    return records.groupBy(*by).agg(
        F.count("*").alias("attempted"), failed.alias("failure_rate"), F.sum(F.when(F.col("ok") & (F.col("n_claims") == 0), 1).otherwise(0)).alias("zero_claim"),
        (failed > MOST_FAILURES).alias("suppressed"), F.when(failed <= MOST_FAILURES, mean).alias("faithfulness"),
    )


def seeded_sample(keys: Sequence, n: int, seed: int) -> list:
    """n of the keys by a seeded draw, in their order; all if there are no more than n."""
    keys = list(keys)
    if n >= len(keys):
        return keys
    chosen = set(random.Random(seed).sample(range(len(keys)), n))
    return [k for i, k in enumerate(keys) if i in chosen]


def seeded_rows(rows: DataFrame, keys: Sequence[str], n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """n rows of each group (all, if it has no more), with their place in the draw: those of least hash of seed and keys; ties
    go by the keys. Each task keeps the least n of its own rows, so that only these are shuffled; nothing comes to the driver."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys])), 256)
    group = list(by) or [F.lit(0)]
    place = F.row_number().over(Window.partitionBy(*group).orderBy("drawn_", *keys))
    return rows.withColumn("drawn_", drawn).withColumn("place", place).where(F.col("place") <= n).drop("drawn_")


def refusal_accuracy(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: refusal questions and how many were refused."""
    refused = F.sum(F.when(F.col("gate_outcome") == REFUSAL, 1).otherwise(0))
    return answers.groupBy(*by).agg(F.count("*").alias("n"), refused.alias("refused"), F.round(refused / F.count("*"), 6).alias("accuracy"))


def expansion_counts(questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group, over distinct questions: expansions attempted, fallbacks (not live), intents present and absent."""
    once = questions.dropDuplicates([*by, "question"])
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return once.groupBy(*by).agg(F.count("*").alias("attempts"), number(F.col("status") != "live").alias("fallbacks"), number(F.col("intent").isNotNull()).alias("intent_present"), number(F.col("intent").isNull()).alias("intent_absent"))


def sweep(scored: DataFrame) -> DataFrame:
    """Against weight 0, per weight: hits at 6, flips (hit to miss) and gains (miss to hit) of (weight, query_id, strict_rank)."""
    hit = scored.select("weight", "query_id", (F.coalesce(F.col("strict_rank"), F.lit(99)) <= 6).alias("hit"))
    base = hit.where("weight = 0").select("query_id", F.col("hit").alias("was"))
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return hit.join(base, "query_id").groupBy("weight").agg(F.count("*").alias("n"), number(F.col("hit")).alias("hits"), number(F.col("was") & ~F.col("hit")).alias("flips"), number(~F.col("was") & F.col("hit")).alias("gains"))


def is_canonical(run: dict) -> bool:
    """Whether a run may stand as the published one: all its parts done, nothing failed, default depth.

    run has: answerable (by set), modes, distinct_files, refusals_scored, completeness_scored, top_k, generation_errors,
    expansion_attempts, expansion_fallbacks, lexical_loaded, lexical_needed (whether a retrieval of ours was in play), judge
    (attempted and errors by set).
    """
    sets = run["answerable"]
    judged = run["judge"]
    return all((
        sets.get("heldout", 0) > 0, sets.get("realistic", 0) > 0, set(run["modes"]) == set(MODES), run["distinct_files"], run["refusals_scored"], run["completeness_scored"],
        run["top_k"] == 6, run["generation_errors"] == 0, run["expansion_attempts"] > 0, run["expansion_fallbacks"] == 0, run["lexical_loaded"] or not run["lexical_needed"],
        bool(judged) and all(j["attempted"] > 0 and j["errors"] == 0 for j in judged.values()),
    ))


def wilson_value(hits: int, n: int) -> tuple[float, float]:
    """The interval of plain numbers, for reports."""
    if not n:
        return 0.0, 0.0
    p, d = hits / n, 1 + Z * Z / n
    c, h = (p + Z * Z / (2 * n)) / d, Z / d * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return max(0.0, c - h), min(1.0, c + h)

