"""SQL of the registered queries, for a second engine over the same tables."""

from __future__ import annotations

TOKENS = r"regexp_extract_all(lower(coalesce({c}, '')), '[0-9]+(?:\.[0-9]+)+|[\p{{L}}\p{{N}}_]+')"


def tokens(c: str) -> str:
    return TOKENS.format(c=c)


def corpus() -> str:
    """CTEs t (tokens of each document), post (postings), st (corpus) and terms (idf)."""
    return f"""
t AS MATERIALIZED (SELECT doc_id, lang, {tokens('text')} AS ts FROM documents),
post AS MATERIALIZED (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY doc_id, lang, dl, term),
st AS MATERIALIZED (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term),
idf0 AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, st),
mean AS MATERIALIZED (SELECT 0.25 * avg(i) AS m FROM idf0),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN i < 0 THEN m ELSE i END AS idf FROM idf0, mean)"""


def bm25(name: str, questions: str, k: int, where: str = "true", key: str = "query_id") -> str:
    """A CTE of that name: (key, doc_id, score, rank) of questions (key, question)."""
    return f"""
{name}_q AS (SELECT {key}, term, count(*) AS qtf FROM (SELECT {key}, unnest({tokens('question')}) AS term FROM {questions}) GROUP BY {key}, term),
{name}_s AS (SELECT {key}, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN terms USING (term) JOIN post USING (term), st WHERE {where} GROUP BY {key}, doc_id),
{name} AS (SELECT {key}, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def rrf(name: str, lists: str, k: int, group: str = "query_id") -> str:
    """A CTE of that name: fused ranks of lists (group, list_ord, weight, doc_id, rank)."""
    return f"""
{name}_f AS (SELECT {group}, doc_id, round(sum(weight / (60 + rank)), 9) AS score, min(list_ord * 100000 + rank) AS first FROM {lists} GROUP BY {group}, doc_id),
{name} AS (SELECT {group}, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, first, doc_id) AS rank FROM {name}_f) WHERE rank <= {k})"""
