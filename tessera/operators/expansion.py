"""Query expansion: reading what a language model answers, and the statuses of an expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fold, strip, unquote
from tessera.operators.answers import Answers

#: List markers, the tag of the intent line, most rewrites, most characters of one (fixed values).
MARKER, INTENT_TAG, MOST, LONGEST = r"^\s*(?:[0-9]+[.)]|[-*•])\s*", "INTENT:", 3, 200
MARKED = r"^\s*(?:[0-9]+[.)]|[-*•])\s*(.+)$"


def _split(answer: Column) -> Column:
    return F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r]", -1)


def _tagged(line: Column) -> Column:
    return F.regexp_replace(line, MARKER, "").startswith(INTENT_TAG)


def intent(answer: Column) -> Column:
    """The text of the first tagged line, null if there is none, or it is empty or too long."""
    first = F.try_element_at(F.filter(_split(answer), _tagged), F.lit(1))
    said = strip(F.substring(F.regexp_replace(first, MARKER, ""), F.lit(len(INTENT_TAG) + 1), F.length(first)))
    return F.when((F.length(said) > 0) & (F.length(said) <= LONGEST), said)


def without_intent(answer: Column) -> Column:
    """The answer without its tagged lines; as it stands if there are none."""
    rest = F.filter(_split(answer), lambda x: ~_tagged(x))
    return F.when(F.exists(_split(answer), _tagged), F.array_join(rest, "\n")).otherwise(answer)


def rewrites(answer: Column) -> Column:
    """Up to three rewrites: marked lines, or all lines if none is marked; stripped and unquoted once, without blank,
    too long, letterless and repeated ones."""
    own = _split(answer)
    marked = F.filter(own, lambda x: x.rlike(MARKED))
    bare = F.transform(F.filter(own, lambda x: strip(x) != ""), lambda x: F.regexp_replace(x, MARKER, ""))
    found = F.when(F.size(marked) > 0, F.transform(marked, lambda x: F.regexp_extract(x, MARKED, 1))).otherwise(bare)
    clean = F.filter(F.transform(found, lambda x: strip(unquote(strip(x)))), lambda x: (x != "") & (F.length(x) <= LONGEST) & x.rlike(r"\p{L}"))
    once = F.filter(clean, lambda x, k: F.array_position(F.transform(clean, lambda y: fold(y)), fold(x)) == k + 1)
    return F.slice(once, F.lit(1), F.lit(MOST))


def expand(questions: DataFrame, call: Callable[[str], str] | None, enabled: bool = True, has_key: bool = True, answers: Answers | None = None, kind: str = "expansion") -> DataFrame:
    """questions with rewrites, intent and status (live, no_key, api_error, parse_error, disabled).

    `call` asks a language model for one question, once for each text that `answers` does not hold (see Answers). It never fails a query: an error gives api_error, an answer without
    usable rewrites parse_error (its intent is kept). Rewrites and intents that repeat the question are dropped.
    """
    none = F.array().cast("array<string>")
    if not enabled or not has_key or call is None:
        return questions.withColumns({"rewrites": none, "intent": F.lit(None).cast("string"), "status": F.lit("no_key" if enabled else "disabled")})

    table = answers or Answers(questions.sparkSession)
    answered = table.ask(questions.drop("answer", "error"), "question", call, kind).withColumnRenamed("answer", "answer_").drop("error")
    asked = fold(strip(F.col("question")))
    found = F.filter(rewrites(without_intent(F.col("answer_"))), lambda x: fold(x) != asked)
    said = intent(F.col("answer_"))
    fresh = said.isNotNull() & (fold(said) != asked) & ~F.exists(F.col("rewrites"), lambda x: fold(x) == fold(said))
    out = answered.withColumn("rewrites", F.coalesce(found, none))
    out = out.withColumn("intent", F.when(fresh, said))
    return out.withColumn("status", F.when(F.col("answer_").isNull(), "api_error").when(F.size("rewrites") == 0, "parse_error").otherwise("live")).drop("answer_")


CACHED = "map<string,struct<rewrites:array<string>,status:string,intent:string>>"


def read_cached(spark: SparkSession, path: str) -> DataFrame:
    """(question, rewrites, status, intent) of a JSON file that maps each question to its expansion."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", CACHED).alias("m"))
    return whole.select(F.explode("m").alias("question", "e")).select("question", F.coalesce("e.rewrites", F.array().cast("array<string>")).alias("rewrites"), "e.status", "e.intent")


def replayed(questions: DataFrame, cached: DataFrame) -> DataFrame:
    """questions with the rewrites, intent and status that were cached for their texts; a question without has a parse error."""
    out = questions.join(cached.dropDuplicates(["question"]), "question", "left")
    return out.withColumns({"rewrites": F.coalesce("rewrites", F.array().cast("array<string>")), "status": F.coalesce("status", F.lit("parse_error"))})
