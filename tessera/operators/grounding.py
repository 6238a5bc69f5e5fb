"""Citations of an answer: extraction, verification against the retrieved chunks, the gate and what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold, strip, unquote

#: What a refusal says, how a caveat begins, the form of a citation.
REFUSAL_PHRASE = "not covered in the source material"
CAVEAT_PREFIX = "The source material does not directly answer this question. The most closely related guidance is:"
CITATION = r"\[[^\]]*?(?:\bpara\s+([0-9]+(?:\.[0-9]+)*)|\b(?i:appendix)\s+([0-9]+(?:\.[0-9]+)*))\s*,\s*pp?\.\s*([0-9]+)[^\]]*?\]"
PASSES = 5
REFUSAL, VERIFIED, PARTIAL, UNVERIFIED = "REFUSAL", "CITATIONS_VERIFIED", "PARTIALLY_VERIFIED", "CITATIONS_UNVERIFIED"


def citations(answer: Column) -> Column:
    """An array of struct(para, page, raw); appendix locators are written APPENDIX n."""
    text = F.coalesce(answer, F.lit(""))
    groups = [F.regexp_extract_all(text, F.lit(CITATION), F.lit(g)).alias(n) for g, n in ((0, "raw"), (1, "para"), (2, "appendix"), (3, "page"))]
    para = lambda c: F.when(c["para"] != "", c["para"]).otherwise(F.concat(F.lit("APPENDIX "), c["appendix"]))
    return F.transform(F.arrays_zip(*groups), lambda c: F.struct(para(c).alias("para"), c["page"].alias("page"), c["raw"].alias("raw")))


def is_refusal(answer: Column) -> Column:
    """Whether an answer is the refusal phrase and nothing else, up to case, quotes and closing dots."""
    peel = lambda t, _: F.element_at(F.transform(F.array(strip(t)), lambda x: strip(F.regexp_replace(unquote(x), r"\.+$", ""))), 1)
    bare = F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), F.coalesce(answer, F.lit("")), peel)
    return fold(bare) == REFUSAL_PHRASE


def is_caveat(answer: Column) -> Column:
    return F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+", "").startswith(CAVEAT_PREFIX)


def sections_related(a: Column, b: Column) -> Column:
    """Whether one section number is the other or nests in it; appendices and paragraphs never relate, nor empty ones."""
    same_kind = a.startswith("APPENDIX") == b.startswith("APPENDIX")
    nested = (a == b) | a.startswith(F.concat(b, F.lit("."))) | b.startswith(F.concat(a, F.lit(".")))
    return F.coalesce((a != "") & (b != "") & same_kind & nested, F.lit(False))


def verify(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answers (query_id, answer) with citations, grounded and ungrounded (in the answer's order, repeats kept).

    results holds (query_id, section_number, page_start, page_end). A citation is grounded if some result of its question
    relates to its section and covers its page. Without a first page a result grounds nothing; without a last page, or
    with 0, it covers one page.
    """
    cited = answers.select("query_id", "answer", citations(F.col("answer")).alias("citations"))
    spans = results.select("query_id", F.coalesce("section_number", F.lit("")).alias("section_"), F.col("page_start").alias("from_"), F.coalesce(F.nullif("page_end", F.lit(0)), "page_start").alias("to_")).where("from_ is not null")
    each = cited.select("query_id", F.posexplode("citations").alias("pos", "c"))
    page = F.col("c.page").try_cast("long")
    hit = each.join(spans, "query_id").where(sections_related(F.col("c.para"), F.col("section_")) & page.between(F.col("from_"), F.col("to_"))).select("query_id", "pos").distinct()
    found = hit.groupBy("query_id").agg(F.collect_set("pos").alias("hits_"))
    told = cited.join(found, "query_id", "left")
    ok = lambda k: F.coalesce(F.array_contains("hits_", k), F.lit(False))
    return told.select("query_id", "answer", "citations", F.filter("citations", lambda c, k: ok(k)).alias("grounded"), F.filter("citations", lambda c, k: ~ok(k)).alias("ungrounded"))


def classify(answer: Column, cited: Column, grounded: Column, ungrounded: Column) -> Column:
    """The gate's outcome from the answer and three counts."""
    return F.when(is_refusal(answer), REFUSAL).when((cited > 0) & (ungrounded == 0), VERIFIED).when((grounded > 0) & (ungrounded > 0), PARTIAL).otherwise(UNVERIFIED)


def gate(verified: DataFrame) -> DataFrame:
    """verify()'s rows with gate_outcome."""
    return verified.withColumn("gate_outcome", classify(F.col("answer"), F.size("citations"), F.size("grounded"), F.size("ungrounded")))


def display(gated: DataFrame, has_results: Column | None = None, override: bool = False) -> DataFrame:
    """What may be shown: (query_id, action, shown, citations). A blocked draft is in no column."""
    outcome = F.col("gate_outcome")
    block = "shown_unverified_override" if override else "blocked_unverified"
    action = F.when(outcome == REFUSAL, "refusal_shown").when(outcome == VERIFIED, "shown").when(outcome == PARTIAL, "shown_with_warning").otherwise(block)
    if has_results is not None:
        action = F.when(~has_results, "no_results").otherwise(action)
    out = gated.withColumn("action", action)
    hidden = F.col("action").isin("blocked_unverified", "no_results")
    return out.select("query_id", "action", F.when(~hidden, F.col("answer")).alias("shown"), F.when(~hidden, F.col("citations")).alias("citations"))
