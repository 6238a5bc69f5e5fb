"""Registered retrieval and evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.text import tokens
from tessera.operators import evaluation, fusion, lexical, neighbours, vector
from tessera.plans import sql
from tessera.sources.shared import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """The index of documents: made once for these files, kept in the shared folder, opened by later queries."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("h")).first()
    path = f"{shared_dir(spark)}/documents-{spark.sparkContext.applicationId}-{state['n']}-{state['h']}"
    try:
        return lexical.LexicalIndex(spark, path)
    except AnalysisException:
        return lexical.LexicalIndex.build(docs, path, keep=("lang",))


EN = "lang = 'en'"
QUESTIONS = "q AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).search(questions(spark, sf_dir), fusion.TOP_K)


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).search(questions(spark, sf_dir), fusion.TOP_K, where=lambda c: c["lang"] == "en")


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector.knn(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), fusion.POOL)


def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stored index of lists: probing all of them, it is exact."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.VectorIndex.build(e, f"{shared_dir(spark)}/lists-{spark.sql('select uuid() as u').first()['u']}")
    return found.search(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), fusion.POOL, probes=len(found.centres))


def vector_arm(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The vector arm of a batch: a question's embedding is that of its number, a document's that of its id."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")

    def arm(subs: DataFrame, depth: int) -> DataFrame:
        own = subs.where("ord = 0").join(e, F.col("query_id") == F.col("doc_id")).select("query_id", "sub_id", "embedding")
        return vector.knn(e, own.select("query_id", "embedding"), depth, key="doc_id").join(own.select("query_id", "sub_id"), "query_id")

    return arm


def bm25_arm(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    own = index(spark, sf_dir)
    return lambda subs, depth: own.search(subs.select("sub_id", "text"), depth, question_key="sub_id", question="text")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumns({"rewrites": F.array().cast("array<string>"), "intent": F.lit(None).cast("string")})
    return fusion.retrieve(fusion.sub_queries(q), {"vector": vector_arm(spark, sf_dir), "bm25": bm25_arm(spark, sf_dir)})


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with rewrites and an intent made of parts of them; the third rewrite repeats the first, the last is blank."""
    t = tokens(F.col("question"))
    part = lambda a, n: F.array_join(F.slice(t, a, n), " ")
    return questions(spark, sf_dir).withColumns({"rewrites": F.array(part(1, 6), F.concat(F.lit(" "), part(5, 6)), F.concat(part(1, 6), F.lit("\t")), F.lit(" ")), "intent": part(9, 5)})


def sub_query_sql(weight: str = "0.25", name: str = "sub", short: bool = False) -> str:
    """A CTE of that name, of questions q; `short` asks for a part of each question instead of the whole."""
    t = sql.tokens("question")
    part = lambda a, n: f"array_to_string(list_slice({t}, {a}, {a + n - 1}), ' ')"
    return f"""
{name}_raw AS (SELECT query_id, 0 AS pos, 0 AS kind, {part(9, 4) if short else "question"} AS text FROM q
  UNION ALL SELECT query_id, 1, 1, {part(1, 6)} FROM q UNION ALL SELECT query_id, 2, 1, {part(5, 6)} FROM q
  UNION ALL SELECT query_id, 5, 2, {part(9, 5)} FROM q WHERE {weight} > 0),
{name}_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY pos) AS n FROM {name}_raw WHERE kind = 0 OR text <> '') WHERE n = 1),
{name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS ord, text, kind,
  CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 / sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) ELSE {weight} END::DOUBLE AS weight FROM {name}_one)"""


def sub_query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fusion.sub_queries(expanded(spark, sf_dir))
    return s.select("query_id", F.col("ord").cast("long").alias("ord"), "kind", "text", F.round("weight", 6).alias("weight"))


def rrf_weighted_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.retrieve(fusion.sub_queries(expanded(spark, sf_dir)), {"bm25": bm25_arm(spark, sf_dir)})


WEIGHTED = f"""WITH {QUESTIONS}, {sub_query_sql()},
s AS (SELECT query_id::VARCHAR || ':' || ord::VARCHAR AS sub_id, text AS question, query_id, ord, weight FROM sub),
{sql.corpus()}, {sql.bm25('b', 's', 12, key='sub_id')},
lists AS (SELECT s.query_id, ord AS list_ord, weight, doc_id, rank FROM b JOIN s USING (sub_id)), {sql.rrf('r', 'lists', 6)}
SELECT * FROM r"""


WEIGHTS = (0.0, 0.25, 0.5)


def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent weights 0, .25 and .5 on cached expansions, against the document that the whole question finds."""
    golden = known_items(spark, sf_dir)
    own = expanded(spark, sf_dir).withColumn("question", F.array_join(F.slice(tokens(F.col("question")), 9, 4), " "))
    lists = fusion.ranked_lists(fusion.sub_queries(own, fusion.MOST_INTENT), {"bm25": bm25_arm(spark, sf_dir)}, fusion.POOL)
    found = fusion.fused(lists, [fusion.Plan(str(w), intent_weight=w) for w in WEIGHTS]).select(F.col("plan").cast("double").alias("weight"), "query_id", "rank", F.col("doc_id").cast("string").alias("section_number"))
    each = golden.join(F.broadcast(spark.createDataFrame([(w,) for w in WEIGHTS], "weight double")))  # three weights
    return evaluation.sweep(evaluation.first_match(each, found, fusion.TOP_K))


def _sweep_sql() -> str:
    parts = [f"WITH {QUESTIONS}, {sql.corpus()}, {sql.bm25('g', 'q', 1)}"]
    hits = []
    for k, w in enumerate(WEIGHTS):
        parts.append(sub_query_sql(w, f"s{k}", short=True))
        parts.append(f"a{k} AS (SELECT query_id::VARCHAR || ':' || ord::VARCHAR AS sub_id, text AS question, query_id, ord, weight FROM s{k})")
        parts.append(sql.bm25(f"b{k}", f"a{k}", 12, key="sub_id"))
        parts.append(f"l{k} AS (SELECT a{k}.query_id, ord AS list_ord, weight, doc_id, rank FROM b{k} JOIN a{k} USING (sub_id))")
        parts.append(sql.rrf(f"r{k}", f"l{k}", 6))
        hits.append(f"SELECT {w}::DOUBLE AS weight, g.query_id, count(r{k}.rank) > 0 AS hit FROM g LEFT JOIN r{k} ON r{k}.query_id = g.query_id AND g.query_id % 2 = 0 AND r{k}.doc_id = g.doc_id GROUP BY g.query_id")
    return ", ".join(parts) + f""", h AS ({" UNION ALL ".join(hits)}), z AS (SELECT query_id, hit AS was FROM h WHERE weight = 0)
SELECT weight, count(*) AS n, sum(hit::INT)::BIGINT AS hits, sum((was AND NOT hit)::INT)::BIGINT AS flips, sum((hit AND NOT was)::INT)::BIGINT AS gains FROM h JOIN z USING (query_id) GROUP BY weight"""


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden set: each passage's best document, or for odd questions a section that nests in it, is what a shorter question
    should find: so the odd ones are only ever met by related sections."""
    best = index(spark, sf_dir).search(questions(spark, sf_dir), 1)
    kind = F.when(F.col("query_id") % 2 == 0, "direct").otherwise("exact_token")
    section = F.concat(F.col("doc_id").cast("string"), F.when(F.col("query_id") % 2 == 0, "").otherwise(".1"))
    return best.select("query_id", kind.alias("type"), F.array(section).alias("expected_sections"))


def short_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("question", F.array_join(F.slice(tokens(F.col("question")), 3, 4), " "))
    found = index(spark, sf_dir).search(q, 6)
    return found.select("query_id", "rank", F.col("doc_id").cast("string").alias("section_number"))


def first_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = evaluation.first_match(known_items(spark, sf_dir), short_results(spark, sf_dir), 6)
    return ranks.select("query_id", "type", F.col("strict_rank").cast("long").alias("strict_rank"), F.col("related_rank").cast("long").alias("related_rank"))


def hit_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = evaluation.first_match(known_items(spark, sf_dir), short_results(spark, sf_dir), 6)
    return evaluation.hit_metrics(ranks.withColumn("set", F.lit("benchmark")), ["set", "type"], also_total="type")


_SHORT = f"array_to_string(list_slice({sql.tokens('text')}, 3, 6), ' ')"
RANKS = f"""WITH {QUESTIONS}, s AS (SELECT item_id AS query_id, {_SHORT} AS question FROM benchmark),
{sql.corpus()}, {sql.bm25('g', 'q', 1)}, {sql.bm25('b', 's', 6)},
r AS (SELECT g.query_id, CASE WHEN g.query_id % 2 = 0 THEN 'direct' ELSE 'exact_token' END AS type, min(b.rank) AS k
  FROM g LEFT JOIN b ON b.query_id = g.query_id AND b.doc_id = g.doc_id GROUP BY g.query_id)"""


def _hits(cuts: tuple[int, ...]) -> str:
    """Hits, rates and reciprocal ranks of r: the strict ones are those of even questions."""
    rank = {"strict": "CASE WHEN query_id % 2 = 0 THEN k END", "related": "k"}
    one = lambda m, c: f"sum(CASE WHEN {rank[m]} <= {c} THEN 1 ELSE 0 END)"
    return ", ".join([f"{one(m, c)}::BIGINT AS {m}_hits_{c}, round({one(m, c)}::DOUBLE / count(*), 6) AS {m}_rate_{c}" for m in rank for c in cuts] + [f"round(avg(coalesce(1.0 / CASE WHEN k <= {cuts[-1]} THEN {rank[m]} END, 0)), 6) AS {m}_mrr" for m in rank])




def by_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each type and of all, by the language of the document that is looked for, too."""
    ranks = evaluation.first_match(known_items(spark, sf_dir), short_results(spark, sf_dir), 3)
    best = F.regexp_extract(F.element_at("expected_sections", 1), "^[0-9]+", 0).cast("long")
    own = ranks.withColumn("doc_id", best).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.hit_metrics(own.select("lang", "type", "strict_rank", "related_rank"), ["lang", "type"], 3, also_total="type")


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("hits"))
    low, high = evaluation.wilson(F.col("hits"), F.col("n"))
    return own.select("lang", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = bm25_topk(spark, sf_dir).join(docs, "doc_id")
    header = F.when(F.col("doc_id") % 2 == 0, fusion.handbook_header(F.col("doc_id").cast("string"), F.col("doc_id"), F.col("doc_id") + F.col("doc_id") % 3)).otherwise(fusion.generic_header(F.col("rank"), F.lit(None).cast("string"), F.col("doc_id").cast("string"), F.col("source")))
    made = fusion.context(found.select("query_id", "rank", header.alias("header"), "text"), questions(spark, sf_dir))
    return made.select("query_id", F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("sha256"))


CONTEXT = f"""WITH {QUESTIONS}, {sql.corpus()}, {sql.bm25('b', 'q', 6)},
h AS (SELECT query_id, rank, CASE WHEN d.doc_id % 2 = 0
    THEN '[Handbook, para ' || d.doc_id || CASE WHEN d.doc_id % 3 > 0 THEN ', pp.' || d.doc_id || '–' || (d.doc_id + d.doc_id % 3) ELSE ', p.' || d.doc_id END || ']'
    ELSE '[Source ' || rank || ': Unknown, Section ' || d.doc_id || ' | ' || source || ']' END || chr(10) || text || chr(10) || '---' AS part
  FROM b JOIN documents d USING (doc_id)),
c AS (SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS c FROM h GROUP BY query_id),
f AS (SELECT q.query_id, coalesce(c, 'No relevant documents found.') AS c FROM q LEFT JOIN c USING (query_id))
SELECT query_id, length(c)::BIGINT AS n_chars, sha256(c) AS sha256 FROM f"""

FUSED = f"""WITH {QUESTIONS}, {sql.corpus()}, {sql.bm25('b', 'q', 12)},
v AS (SELECT * FROM (SELECT a.vec_id AS query_id, e.vec_id AS doc_id,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings a JOIN q ON a.vec_id = q.query_id, embeddings e) WHERE rank <= 12),
lists AS (SELECT query_id, 0 AS list_ord, 1.0::DOUBLE AS weight, doc_id, rank FROM v UNION ALL SELECT query_id, 1000, 1.0, doc_id, rank FROM b), {sql.rrf('r', 'lists', 6)}
SELECT * FROM r"""

KNN = """SELECT * FROM (SELECT a.vec_id AS query_id, e.vec_id, round(list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings a, embeddings e WHERE a.vec_id % 20 = 0) WHERE rank <= 12"""

QUERIES = {f.__name__: f for f in (tokenize_stats, term_idf, bm25_topk, bm25_filtered, knn_exact, knn_lists, rrf_fuse, sub_query_weights, rrf_weighted_rewrites, weight_sweep, first_match_rank, hit_at_k_mrr, by_type_rollup, wilson_ci, context_format)}
ORACLE = {
    "tokenize_stats": f"SELECT doc_id, len({sql.tokens('text')})::BIGINT AS n_tokens, len(list_distinct({sql.tokens('text')}))::BIGINT AS n_terms FROM documents",
    "term_idf": f"WITH {sql.corpus()} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {QUESTIONS}, {sql.corpus()}, {sql.bm25('b', 'q', 6)} SELECT * FROM b",
    "bm25_filtered": f"WITH {QUESTIONS}, {sql.corpus()}, {sql.bm25('b', 'q', 6, where=EN)} SELECT * FROM b",
    "knn_exact": KNN,
    "knn_lists": KNN,
    "rrf_fuse": FUSED,
    "sub_query_weights": f"WITH {QUESTIONS}, {sub_query_sql()} SELECT query_id, ord, CASE kind WHEN 0 THEN 'original' WHEN 1 THEN 'rewrite' ELSE 'intent' END AS kind, text, round(weight, 6) AS weight FROM sub",
    "rrf_weighted_rewrites": WEIGHTED,
    "first_match_rank": f"{RANKS} SELECT query_id, type, CASE WHEN query_id % 2 = 0 THEN k END AS strict_rank, k AS related_rank FROM r",
    "weight_sweep": _sweep_sql(),
    "by_type_rollup": f"{RANKS}, o AS (SELECT r.*, lang FROM r JOIN g USING (query_id) JOIN documents d ON d.doc_id = g.doc_id) SELECT lang, coalesce(type, 'overall') AS type, count(*) AS n, {_hits((1, 3))} FROM o GROUP BY GROUPING SETS ((lang, type), (lang))",
    "hit_at_k_mrr": f"{RANKS} SELECT 'benchmark' AS set, coalesce(type, 'overall') AS type, count(*) AS n, {_hits((1, 3, 6))} FROM r GROUP BY GROUPING SETS ((type), ())",
    "wilson_ci": """WITH w AS (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS hits FROM labels JOIN documents USING (doc_id) GROUP BY lang),
c AS (SELECT *, hits::DOUBLE / n AS p, 1 + 1.96 * 1.96 / n AS d FROM w),
e AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / d AS m, (1.96 / d) * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) AS h FROM c)
SELECT lang, n, hits, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM e""",
    "context_format": CONTEXT,
}
