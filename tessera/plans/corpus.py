"""Registered queries over pages, HTML, answers, chunks and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id
from tessera.operators import audit, chunking, evaluation, expansion, grounding, pages, store
from tessera.plans.retrieval import read
from tessera.sources import html
from tessera.sources.shared import held


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, their lines as pages."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select("source", (F.col("pos") + 1).alias("page_number"), "text")


def as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one source each."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("doc_id").alias("page_number"), "text")


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages.page_map(raw_pages(spark, sf_dir).withColumn("printed_page", F.col("page_number")))
    long = lambda c: F.col(c).cast("long").alias(c)
    return own.select("source", long("page_number"), long("char_start"), long("char_end"), F.md5("text").alias("md5"), "separator")


_PAGES = """p AS (SELECT source, page_number, text, lead(text) OVER (PARTITION BY source ORDER BY page_number) AS nxt
  FROM (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents)),
s AS (SELECT *, regexp_matches(text, '[a-z]-$') AND coalesce(regexp_matches(nxt, '^\\p{Ll}'), false) AS seam FROM p),
m AS (SELECT source, page_number, CASE WHEN seam THEN left(text, length(text) - 1) ELSE text END AS text, CASE WHEN nxt IS NULL OR seam THEN '' ELSE chr(10) END AS separator FROM s),
o AS (SELECT *, coalesce(sum(length(text) + length(separator)) OVER (PARTITION BY source ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM m)"""


def page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the middle and of the end of each document."""
    mapped = held(pages.page_map(raw_pages(spark, sf_dir).withColumn("printed_page", F.col("page_number"))).drop("text"))
    sizes = mapped.groupBy("source").agg(F.max(F.col("char_end") + F.length("separator")).cast("long").alias("n_chars"))
    middle = F.floor(F.col("n_chars") / 2)
    asked = sizes.withColumns({"first": middle, "last": F.greatest(middle, F.col("n_chars") - 1)})
    found = pages.pages_at(mapped, pages.pages_at(mapped, asked, "first", "page_middle"), "last", "page_end")
    return found.select("source", "n_chars", F.col("page_middle").cast("long").alias("page_middle"), F.col("page_end").cast("long").alias("page_end"))


def page_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page maps of which each seventh source has a second page that begins a character early, or is moved onto the first."""
    own = pages.page_map(raw_pages(spark, sf_dir).withColumn("printed_page", F.col("page_number")))
    wrong = (F.col("source") % 7 == 0) & (F.col("page_number") == 2)
    start = F.col("char_start") - F.when(wrong, F.when(F.col("source") % 2 == 0, 1).otherwise(F.col("char_start") + 1)).otherwise(0)
    return pages.invariants(own.withColumn("char_start", start)).groupBy("problem").agg(F.count("*").alias("n"))


def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of each source, by a seed."""
    own = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_number"), "text")
    return evaluation.seeded_rows(own, ["page_number"], 5, 7, by=["source"]).select("source", "page_number", F.col("place").cast("long").alias("place"))


def line_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, each under a numbered heading."""
    d = F.col("doc_id")
    head = F.concat((d % 12).cast("string"), F.lit("."), (F.col("n_chars") % 40).cast("string"), F.when(d % 3 == 0, F.concat(F.lit("."), (d % 5).cast("string"))).otherwise(""), F.lit(" Heading\n"))
    own = read(spark, sf_dir, "documents").select(d.alias("source"), d.alias("page_number"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return pages.numbering_census(own).select(F.col("depth").cast("long").alias("depth"), "n", F.array_join("examples", " ").alias("examples"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repeated_lines(as_pages(spark, sf_dir), 0.005)


_LINES = r"l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents)"


def char_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.character_census(as_pages(spark, sf_dir))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = as_pages(spark, sf_dir)
    return pages.coverage(own).crossJoin(pages.hyphen_census(own).select("n_hyphen_lines")).crossJoin(pages.fidelity(own))  # three single rows


def header_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.header_census(as_pages(spark, sf_dir))


def hyphen_attest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages.attested(as_pages(spark, sf_dir))
    return own.select("source", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of page cleaning over all lines as pages."""
    own = pages.extract(raw_pages(spark, sf_dir))
    return own.select("source", F.length("clean_text").cast("long").alias("n_chars"), F.size("page_map").cast("long").alias("n_pages"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = html.load(read(spark, sf_dir, "pages"), "legislation")
    return own.select("source", "title", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


#: The references of the test pages, by code points; SQL knows no others.
_SQL_REFERENCES = {"&lt;": 60, "&gt;": 62, "&quot;": 34, "&copy;": 169, "&middot;": 183, "&nbsp;": 160, "&eacute;": 233}


def _sql_html() -> str:
    t = "regexp_replace(coalesce(html, ''), '<!--.*?-->|<![^>]*>', chr(1), 'gis')"
    for tag in ("script", "style", "nav", "footer", "header"):
        t = f"regexp_replace({t}, '<{tag}\\b[^>]*>.*?(</{tag}\\s*>|$)', chr(1), 'gis')"

    def plain(c: str) -> str:
        for name, code in _SQL_REFERENCES.items():
            c = f"replace({c}, '{name}', chr({code}))"
        return f"regexp_replace({c}, '&amp;?', '&', 'g')"

    strip = lambda c: rf"regexp_replace({c}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
    first = lambda tag: f"regexp_extract(html, '<{tag}\\b[^>]*>(.*?)(?:</{tag}|$)', 1, 'is')"
    take = lambda tag: f"array_to_string(list_transform(regexp_split_to_array({first(tag)}, '<[^>]*(>|$)'), lambda x: {strip(plain('x'))}), '')"
    return f"""WITH d AS (SELECT url, html, {t} AS t FROM pages),
c AS (SELECT url, html, CASE WHEN regexp_matches(t, '<body\\b[^>]*>', 'is') THEN regexp_replace(regexp_extract(t, '<body\\b[^>]*>(.*)', 1, 'is'), '</body\\s*>.*', '', 'is') ELSE t END AS i FROM d),
e AS (SELECT url, html, array_to_string(list_filter(list_transform(string_split(regexp_replace(i, '<[a-zA-Z/][^>]*(>|$)', chr(1), 'gs'), chr(1)), lambda x: {strip(plain('x'))}), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT url AS source, CASE WHEN {take('title')} <> '' THEN {take('title')} WHEN regexp_matches(html, '<h1\\b[^>]*>', 'i') THEN {take('h1')} ELSE url END AS title, length(text)::BIGINT AS n_chars, sha256(text) AS sha256 FROM e WHERE text <> ''"""


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(evaluation.sentences(F.col("text"))).alias("pos", "sentence"))
    return own.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "sentence")


def _sql_sentences() -> str:
    t = "text"
    for a in evaluation.ABBREVIATIONS:
        held = "".join(f"\\{k + 2}\x01" for k in range(a.count(".")))
        t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])" + "".join(f"({p})\\." for p in a.split(".")[:-1]) + f"', '\\1{held}', 'gi')"
    return rf"""WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+([A-Z"“])', '\1' || chr(10) || '\2', 'g'), chr(10)),
  lambda x: replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(1), '.')), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM c"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per document: refusals, right, wrong and missing citations by its id."""
    d = F.col("doc_id")
    one = F.concat(F.lit("[Handbook, para "), (d % 9 + 1).cast("string"), F.lit("."), (F.col("n_chars") % 7).cast("string"), F.lit(", p."), (d % 30 + 1).cast("string"), F.lit("]"))
    two = F.concat(F.lit("[Handbook, Appendix "), (d % 4 + 1).cast("string"), F.lit(".2, pp."), (d % 30 + 1).cast("string"), F.lit("–99]"))
    text = F.when(d % 5 == 0, F.lit(' "Not covered in the source material." ')).when(d % 5 == 1, F.concat(F.lit("It is so "), one, F.lit(". And more "), two, F.lit("."))).when(d % 5 == 2, F.concat(F.lit("See "), one)).when(d % 5 == 3, F.lit("No citation here.")).otherwise(F.concat(two, F.lit(" applies. Also "), one, F.lit(" and "), one))
    return read(spark, sf_dir, "documents").select(d.alias("query_id"), text.alias("answer"), "lang", "n_chars")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("query_id")
    return _answers(spark, sf_dir).select("query_id", F.when(d % 2 == 0, (d % 9 + 1).cast("string")).otherwise(F.concat(F.lit("APPENDIX "), (d % 4 + 1).cast("string"))).alias("section_number"), F.when(d % 11 > 0, (d % 28 + 1)).cast("int").alias("page_start"), F.when(d % 3 == 0, d % 28 + 5).when(d % 3 == 1, 0).cast("int").alias("page_end"))


ANSWERS = """a AS (SELECT doc_id AS query_id, lang, n_chars,
  '[Handbook, para ' || (doc_id % 9 + 1) || '.' || (n_chars % 7) || ', p.' || (doc_id % 30 + 1) || ']' AS one,
  '[Handbook, Appendix ' || (doc_id % 4 + 1) || '.2, pp.' || (doc_id % 30 + 1) || '–99]' AS two FROM documents),
t AS (SELECT query_id, lang, CASE query_id % 5 WHEN 0 THEN ' "Not covered in the source material." ' WHEN 1 THEN 'It is so ' || one || '. And more ' || two || '.' WHEN 2 THEN 'See ' || one
  WHEN 3 THEN 'No citation here.' ELSE two || ' applies. Also ' || one || ' and ' || one END AS answer FROM a),
p AS (SELECT query_id, answer, regexp_extract_all(answer, '\\[[^\\]]*?(?:\\bpara\\s+([0-9]+(?:\\.[0-9]+)*)|\\b(?i:appendix)\\s+([0-9]+(?:\\.[0-9]+)*))\\s*,\\s*pp?\\.\\s*([0-9]+)[^\\]]*?\\]') AS raws FROM t),
c AS (SELECT query_id, generate_subscripts(raws, 1) - 1 AS pos, unnest(raws) AS raw FROM p),
x AS (SELECT query_id, pos, raw, CASE WHEN raw LIKE '%para %' THEN regexp_extract(raw, 'para\\s+([0-9.]+),', 1) ELSE 'APPENDIX ' || regexp_extract(raw, 'Appendix\\s+([0-9.]+),', 1) END AS para, regexp_extract(raw, 'pp?\\.([0-9]+)', 1) AS page FROM c),
r AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN (query_id % 9 + 1)::VARCHAR ELSE 'APPENDIX ' || (query_id % 4 + 1) END AS section,
  CASE WHEN query_id % 11 > 0 THEN query_id % 28 + 1 END AS a, CASE query_id % 3 WHEN 0 THEN query_id % 28 + 5 WHEN 1 THEN 0 END AS b FROM a),
g AS (SELECT x.query_id, pos, bool_or(coalesce((para LIKE 'APPENDIX%') = (section LIKE 'APPENDIX%') AND (para = section OR starts_with(para, section || '.') OR starts_with(section, para || '.'))
  AND page::INT BETWEEN a AND coalesce(nullif(b, 0), a), false)) AS ok FROM x JOIN r USING (query_id) GROUP BY x.query_id, pos),
n AS (SELECT t.query_id, lang, answer, count(pos) AS n_citations, coalesce(sum(ok::INT), 0)::BIGINT AS n_grounded FROM t LEFT JOIN g USING (query_id) GROUP BY ALL),
o AS (SELECT *, CASE WHEN answer LIKE '%Not covered%' THEN 'REFUSAL' WHEN n_citations > 0 AND n_grounded = n_citations THEN 'CITATIONS_VERIFIED' WHEN n_grounded > 0 THEN 'PARTIALLY_VERIFIED' ELSE 'CITATIONS_UNVERIFIED' END AS gate_outcome FROM n)"""


def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _answers(spark, sf_dir).select("query_id", F.posexplode(grounding.citations(F.col("answer"))).alias("pos", "c"))
    return own.select("query_id", F.col("pos").cast("long").alias("pos"), "c.para", "c.page", "c.raw")


def sections_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    a = F.concat((d % 4).cast("string"), F.when(d % 3 > 0, F.concat(F.lit("."), (d % 13).cast("string"))).otherwise(""))
    b = F.concat(F.when(d % 7 == 0, "APPENDIX ").otherwise(""), (d % 2 * 2).cast("string"), F.lit("."), (d % 26).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", grounding.sections_related(a, b).alias("related"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.gate(grounding.verify(_answers(spark, sf_dir), _results(spark, sf_dir)))


def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _gated(spark, sf_dir)
    shown = grounding.display(own).select("query_id", "action", F.col("shown").isNotNull().alias("is_shown"))
    return own.select("query_id", F.size("citations").cast("long").alias("n_citations"), F.size("grounded").cast("long").alias("n_grounded"), "gate_outcome").join(shown, "query_id")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _gated(spark, sf_dir).join(_answers(spark, sf_dir).select("query_id", "lang"), "query_id")
    told = own.select("lang", "answer", "gate_outcome", F.size("citations").alias("n_citations"), F.size("grounded").alias("n_grounded"), F.lit(None).cast("string").alias("error"))
    return evaluation.completeness(told, ["lang"])


def rewrite_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a model's answer: its sentences as marked lines, one of them an intent."""
    s = F.regexp_replace("text", r"\. ", "\n- ")
    answer = F.concat(F.lit('1. "'), F.left("text", F.lit(40)), F.lit('"\n2) '), s, F.lit("\n* INTENT: "), F.left("text", F.lit(60)), F.lit("\n3. 12\n"))
    own = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", answer.alias("a"))
    found = expansion.rewrites(expansion.without_intent(F.col("a")))
    return own.select("conv_id", "turn", expansion.intent(F.col("a")).alias("intent"), F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("rewrites"))


def judge_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answer per labelled document: claims by its labels, some of them broken or missing."""
    d = F.col("doc_id")
    verdict = F.when(F.col("quality") == 1, "supported").when(F.col("toxic") == 1, "unsupported").otherwise("perhaps")
    claim = F.concat(F.lit('{"claim":"c","verdict":"'), verdict, F.lit('"}'))
    body = F.concat(F.lit('```json\n{"claims":['), F.when(d % 6 > 0, F.concat(claim, F.lit(","), claim, F.lit(',{"claim":"x","verdict":"supported"}'))).otherwise(""), F.lit("]}\n```"))
    raw = F.when(d % 13 == 0, F.lit(None)).when(d % 17 == 0, "no json").otherwise(body)
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    own = read(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", evaluation.judge_record(raw).alias("r"))
    return evaluation.judge_summary(own.select("lang", "r.*"), ["lang"])


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answered questions: the props are the question, the type its action."""
    own = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("question"), F.lit(6).alias("top_k"), F.lit(None).cast("string").alias("document_type"), F.array(F.struct(F.col("user_id").alias("id"))).alias("retrieved"), F.lit("REFUSAL").alias("gate_outcome"), F.col("event_type").alias("action"), F.array(F.struct(F.col("event_type").alias("raw"))).alias("citations"), F.lit(1).alias("n_grounded"), F.lit(0).alias("n_ungrounded"), F.col("event_type").alias("answer"))
    told = audit.events(own, at=F.col("event_id").cast("string"))
    return told.select(F.col("timestamp").alias("event"), "query_sha256", F.col("query_chars").cast("long").alias("query_chars"), "action", F.col("answer_chars").cast("long").alias("answer_chars"), F.element_at("retrieved", 1)["id"].alias("first_id"), F.element_at("citation_locators", 1).alias("locator"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", chunk_id(F.col("source"), F.col("text")).alias("chunk_id"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select("source", "text", F.col("lang").alias("title"), "doc_id")
    return store.with_ids(own).withColumn("chunk_ord", F.col("doc_id"))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_of_each(_snapshot(spark, sf_dir)).select("chunk_id", "doc_id")


def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the corpus: the older has other titles for some chunks, and each lacks some of the other's."""
    own = store.first_of_each(_snapshot(spark, sf_dir))
    old = own.where("doc_id % 7 <> 3").withColumn("title", F.when(F.col("doc_id") % 7 == 2, "old").otherwise(F.col("title")))
    return store.counts(store.diff(own.where("doc_id % 7 <> 4"), old))


def legislation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("document_type"), "text")
    return chunking.chunk_legislation(docs)


def intent_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged line of each user turn's made-up answer: the first of two, or none."""
    c = F.col("turn") % 3
    answer = F.concat(F.lit("1. one\n"), F.when(c > 0, F.concat(F.lit("- INTENT:  "), F.left(F.regexp_replace("text", r"\s+", " "), F.lit(190)))).otherwise("intent: none"), F.when(c > 1, "\nINTENT: second").otherwise(""))
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", expansion.intent(answer).alias("intent"))


def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of numbered words as long as each document, in pieces: blanks are its only separators."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 8).cast("int"))), lambda k: F.lpad(k.cast("string"), 7, "0")), " ")
    own = read(spark, sf_dir, "documents").select("doc_id", words.alias("text"))
    cut = own.select("doc_id", F.posexplode(chunking.split_column(F.col("text"))).alias("pos", "piece"))
    return cut.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("md5"))


def legislation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An act for each document: two parts of sections, by its number."""
    d = F.col("doc_id")
    section = lambda k: F.concat(F.lit("\nSection "), F.lit(k).cast("string"), F.lit(". "), F.lit("It is so enacted by "), d.cast("string"))
    more = F.when(d % 2 == 0, section(3)).otherwise("")
    text = F.concat(F.lit("An act of "), d.cast("string"), F.lit("\nPART I"), section(1), section(2), F.lit("\nPART II"), more, F.lit("\n7.\u2014 Last of "), d.cast("string"))
    docs = read(spark, sf_dir, "documents").select(d.cast("string").alias("source"), F.concat(F.lit("Act "), d.cast("string")).alias("title"), F.col("lang").alias("document_type"), text.alias("text"))
    return chunking.chunk_legislation(docs).select("source", "document_type", "section_number", "parent_section", F.col("chunk_ord").cast("long").alias("chunk_ord"), "text")


def handbook_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handbook for each document, by its number: two chapters of two or three sections, an appendix, a runt, an index."""
    d = F.col("doc_id")
    body = lambda k: F.concat(F.lit("\nbody "), F.repeat(F.lit("x"), F.lit(620) + (d + k) % 90))
    one = F.concat(F.lit("CHAPTER 1\nON FIRST THINGS\n1.1 Head One"), body(1), F.lit("\n1.2 Head Two"), body(2), F.when(d % 2 == 0, F.concat(F.lit("\n1.3 Runt\nshort"))).otherwise(F.concat(F.lit("\n1.3 Head Three"), body(3))))
    two = F.concat(F.lit("\nCHAPTER 2\nMORE\n2.1 Again"), body(4), F.lit("\nAPPENDIX 2.1 FORM"), body(5), F.lit("\nINDEX\nthings 1.1"))
    front = F.lit("A title page\n")
    text, first = F.concat(front, one, two), F.length(front) + F.length(one)
    span = lambda n, a, b: F.struct(F.lit(n).alias("page_number"), (F.lit(n) + F.col("doc_id").cast("int") % 5).alias("printed_page"), a.cast("int").alias("char_start"), b.cast("int").alias("char_end"))
    spans = F.array(span(1, F.lit(0), first), span(2, first + 1, F.length(text)))
    docs = read(spark, sf_dir, "documents").select(d.cast("string").alias("source"), F.lit("my_book.pdf").alias("title"), F.lit("handbook").alias("document_type"), text.alias("clean_text"), spans.alias("page_map"))
    own = chunking.chunk_handbook(docs)
    long = lambda c: F.col(c).cast("long").alias(c)
    return own.select("source", long("chunk_ord"), long("chapter_number"), "chapter_title", "section_number", "heading", long("page_start"), long("page_end"), F.md5("text").alias("md5"))


def handbook_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter for each document with lines that look like headings and are none, a bare appendix line, an appendix stub, and a
    section of numbered words that is too long for one chunk."""
    d = F.col("doc_id")
    body = lambda k: F.concat(F.repeat(F.lit("x"), F.lit(640) + (d + k) % 70), F.lit("\n"))
    words = F.array_join(F.transform(F.sequence(F.lit(1), (F.lit(600) + d % 200).cast("int")), lambda k: F.lpad(k.cast("string"), 7, "0")), " ")
    odd = "04.2 Zero Lead\n5.1 Other Chapter\n4.2 lower opener\n4.3 Contents line .... 12\n"
    text = F.concat(F.lit("CHAPTER 4\nCASES OF IT\n4.1 First Head\n"), body(1), F.lit(odd + "4.4 eForms Are Fine\n"), body(2), F.lit("APPENDIX 4.1\n\nForm Of Notice\n"), body(3), F.lit("APPENDIX 4.2 Stub\nx\n4.5 Long Section\n"), words, F.lit("\nINDEX\nthings 4.1"))
    span = F.struct(F.lit(1).alias("page_number"), F.lit(9).alias("printed_page"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"))
    docs = read(spark, sf_dir, "documents").select(d.cast("string").alias("source"), F.lit("my_book.pdf").alias("title"), F.lit("handbook").alias("document_type"), text.alias("clean_text"), F.array(span).alias("page_map"))
    own = chunking.chunk_handbook(docs)
    return own.select("source", F.col("chunk_ord").cast("long").alias("chunk_ord"), "section_number", "heading", F.col("page_end").cast("long").alias("page_end"), F.md5("text").alias("md5"))


def refusal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _gated(spark, sf_dir).join(_answers(spark, sf_dir).select("query_id", "lang"), "query_id")
    return evaluation.refusal_accuracy(own, ["lang"])


def null_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which each third has no title and each fourth no section."""
    d = F.col("doc_id")
    own = read(spark, sf_dir, "documents").select(F.when(d % 3 > 0, F.col("lang")).alias("title"), F.when(d % 4 > 0, d.cast("string")).alias("section_number"))
    return store.dropped_keys(own).select(F.col("dropped").cast("long").alias("dropped"), F.col("affected").cast("long").alias("affected"))


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insert adds to a store of every second chunk."""
    own = _snapshot(spark, sf_dir)
    return store.new_chunks(own, store.first_of_each(own).where("doc_id % 2 = 0")).select("chunk_id", "doc_id")


def chapter_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages under a chapter line each."""
    own = read(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("page_number"), F.concat(F.lit("CHAPTER "), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise(""), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return pages.chapter_census(own)


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as handbooks of pages under running headers: the numbers read and inferred, and what the headers leave."""
    d, k = F.col("doc_id"), F.col("k")
    shift = (d % 3).cast("int")
    head = F.when(k % 4 == 0, F.concat((k - shift).cast("string"), F.lit(" A RUNNING TITLE"))).when(k % 4 == 1, F.concat(F.lit("THE CHAPTER'S TITLE "), (k - shift).cast("string"))).when(k % 4 == 2, "plain first line").otherwise(F.concat(F.lit("OTHER "), (k + 40).cast("string")))
    text = F.concat(head, F.lit("\nbody of "), d.cast("string"), F.lit("\n"), k.cast("string"))
    raw = read(spark, sf_dir, "documents").select(d.alias("source"), F.explode(F.sequence(F.lit(4), F.lit(12))).alias("k"), d).select("source", F.col("k").alias("page_number"), text.alias("text"))
    own = pages.clean(raw)
    long = lambda c: F.col(c).cast("long").alias(c)
    return own.select("source", long("page_number"), long("printed_page"), F.md5("text").alias("md5"))


QUERIES = {f.__name__: f for f in (intent_extract, recursive_split, legislation_sections, handbook_chunk, handbook_cases, refusal_accuracy, null_metadata, insert_new, chapter_census, page_numbers, page_map, page_asof, page_invariants, page_sample, line_census, repeated_lines, char_census, page_coverage, header_census, hyphen_attest, extract_pages, html_text, sentence_split, citations_extract, sections_related, grounding_gate, completeness, rewrite_parse, judge_agg, audit_events, chunk_ids, dedup_first, sync_diff, legislation_split)}
_UNQUOTE = "CASE WHEN length(x) >= 2 AND " + " THEN x[2:-2] WHEN length(x) >= 2 AND ".join(f"x[1] = '{a}' AND x[-1] = '{b}'" for a, b in (('"', '"'), ("\'\'", "\'\'"), ("“", "”"), ("‘", "’"))) + " THEN x[2:-2] ELSE x END"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_BODY = "chr(10) || 'body ' || repeat('x', 620 + (doc_id + {k}) % 90)"
ORACLE = {
    "intent_extract": rf"""WITH u AS (SELECT conv_id, turn, left(regexp_replace(text, '\s+', ' ', 'g'), 190) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN nullif({_STRIP.format(x='t')}, '') END AS intent FROM u""",
    "recursive_split": """WITH d AS (SELECT doc_id, greatest(1, n_chars // 8) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(CASE WHEN n <= 300 THEN 1 ELSE 1 + CAST(ceil((n - 300) / 240.0) AS BIGINT) END)) AS pos FROM d),
t AS (SELECT doc_id, pos, array_to_string(list_transform(range(pos * 240 + 1, least(n, pos * 240 + 300) + 1), lambda k: lpad(k::VARCHAR, 7, '0')), ' ') AS piece FROM p)
SELECT doc_id, pos, length(piece)::BIGINT AS n_chars, md5(piece) AS md5 FROM t""",
    "legislation_sections": """WITH s AS (SELECT doc_id, lang, unnest([
  {'n': '', 'p': '', 'b': 'An act of ' || doc_id}, {'n': '', 'p': 'PART I', 'b': 'PART I'}, {'n': '1', 'p': 'PART I', 'b': 'Section 1. It is so enacted by ' || doc_id}, {'n': '2', 'p': 'PART I', 'b': 'Section 2. It is so enacted by ' || doc_id},
  {'n': '', 'p': 'PART II', 'b': 'PART II'}, {'n': CASE WHEN doc_id % 2 = 0 THEN '3' END, 'p': 'PART II', 'b': 'Section 3. It is so enacted by ' || doc_id}, {'n': '7', 'p': 'PART II', 'b': '7.— Last of ' || doc_id}]) AS s FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE s.b WHEN 'PART I' THEN 2 WHEN 'PART II' THEN 5 ELSE CASE s.n WHEN '' THEN 1 WHEN '1' THEN 3 WHEN '2' THEN 4 WHEN '3' THEN 6 ELSE 7 END END) - 1 AS k FROM s WHERE s.n IS NOT NULL)
SELECT doc_id::VARCHAR AS source, lang AS document_type, s.n AS section_number, s.p AS parent_section, k AS chunk_ord,
  '[From: Act ' || doc_id || CASE WHEN s.p <> '' THEN ', ' || s.p ELSE '' END || CASE WHEN s.n <> '' THEN ', Section ' || s.n ELSE '' END || '] ' || s.b AS text FROM f""",
    "handbook_cases": f"""WITH d AS (SELECT doc_id, 600 + doc_id % 200 AS n, repeat('x', 640 + (doc_id + 1) % 70) AS a, repeat('x', 640 + (doc_id + 2) % 70) AS b, repeat('x', 640 + (doc_id + 3) % 70) AS c FROM documents),
p AS (SELECT doc_id, n, unnest(range(1 + CAST(ceil((n - 300) / 240.0) AS BIGINT))) AS pos FROM d),
r AS (SELECT doc_id, 0 AS k, '4.1' AS s, 'First Head' AS h, 'CHAPTER 4{chr(10)}CASES OF IT{chr(10)}4.1 First Head{chr(10)}' || a || '{chr(10)}04.2 Zero Lead{chr(10)}5.1 Other Chapter{chr(10)}4.2 lower opener{chr(10)}4.3 Contents line .... 12' AS t FROM d
  UNION ALL SELECT doc_id, 1, '4.4', 'eForms Are Fine', '4.4 eForms Are Fine{chr(10)}' || b FROM d
  UNION ALL SELECT doc_id, 2, 'APPENDIX 4.1', 'Form Of Notice', 'APPENDIX 4.1{chr(10)}{chr(10)}Form Of Notice{chr(10)}' || c || '{chr(10)}APPENDIX 4.2 Stub{chr(10)}x' FROM d
  UNION ALL SELECT doc_id, 3, '4.5', 'Long Section', '4.5 Long Section' FROM d
  UNION ALL SELECT doc_id, 4 + pos, '4.5', 'Long Section', array_to_string(list_transform(range(pos * 240 + 1, least(n, pos * 240 + 300) + 1), lambda x: lpad(x::VARCHAR, 7, '0')), ' ') FROM p)
SELECT doc_id::VARCHAR AS source, k::BIGINT AS chunk_ord, s AS section_number, h AS heading, 9::BIGINT AS page_end, md5('[my book, Ch.4 Cases Of It, ' || CASE WHEN s LIKE 'APP%' THEN s ELSE 'para ' || s END || ', p.9] ' || t) AS md5 FROM r""",
    "handbook_chunk": f"""WITH d AS (SELECT doc_id, 1 + doc_id % 5 AS p, 2 + doc_id % 5 AS r, {_BODY.format(k=1)} AS a, {_BODY.format(k=2)} AS b, {_BODY.format(k=3)} AS c, {_BODY.format(k=4)} AS e, {_BODY.format(k=5)} AS f FROM documents),
s AS (SELECT doc_id, unnest([
  {{'k': 0, 'c': 1, 't': 'On First Things', 's': '1.1', 'h': 'Head One', 'p': p, 'b': 'CHAPTER 1' || chr(10) || 'ON FIRST THINGS' || chr(10) || '1.1 Head One' || a}},
  {{'k': 1, 'c': 1, 't': 'On First Things', 's': '1.2', 'h': 'Head Two', 'p': p, 'b': '1.2 Head Two' || b || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '1.3 Runt' || chr(10) || 'short' ELSE '' END}},
  {{'k': 2, 'c': 1, 't': 'On First Things', 's': CASE WHEN doc_id % 2 = 1 THEN '1.3' END, 'h': 'Head Three', 'p': p, 'b': '1.3 Head Three' || c}},
  {{'k': 3 - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, 'c': 2, 't': 'More', 's': '2.1', 'h': 'Again', 'p': r, 'b': 'CHAPTER 2' || chr(10) || 'MORE' || chr(10) || '2.1 Again' || e}},
  {{'k': 4 - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, 'c': 2, 't': 'More', 's': 'APPENDIX 2.1', 'h': 'FORM', 'p': r, 'b': 'APPENDIX 2.1 FORM' || f}}]) AS z FROM d)
SELECT doc_id::VARCHAR AS source, z.k::BIGINT AS chunk_ord, z.c::BIGINT AS chapter_number, z.t AS chapter_title, z.s AS section_number, z.h AS heading, z.p::BIGINT AS page_start, z.p::BIGINT AS page_end,
  md5('[my book, Ch.' || z.c || ' ' || z.t || ', ' || CASE WHEN z.s LIKE 'APP%' THEN z.s ELSE 'para ' || z.s END || ', p.' || z.p || '] ' || z.b) AS md5 FROM s WHERE z.s IS NOT NULL""",
    "refusal_accuracy": f"WITH {ANSWERS} SELECT lang, count(*) AS n, sum((gate_outcome = 'REFUSAL')::INT)::BIGINT AS refused, round(sum((gate_outcome = 'REFUSAL')::INT)::DOUBLE / count(*), 6) AS accuracy FROM o GROUP BY lang",
    "null_metadata": "SELECT (count(*) FILTER (doc_id % 3 = 0 OR lang IS NULL) + count(*) FILTER (doc_id % 4 = 0))::BIGINT AS dropped, count(*) FILTER (doc_id % 3 = 0 OR lang IS NULL OR doc_id % 4 = 0) AS affected FROM documents",
    "insert_new": "WITH f AS (SELECT left(sha256(source || chr(0) || text), 16) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT chunk_id, doc_id FROM f WHERE doc_id % 2 = 1",
    "chapter_census": "SELECT lang AS source, doc_id AS page_number, 'CHAPTER ' || (doc_id % 7) AS line FROM documents WHERE doc_id % 2 = 1",
    "page_numbers": """WITH p AS (SELECT doc_id, unnest(range(4, 13)) AS k FROM documents)
SELECT doc_id AS source, k AS page_number, (k - doc_id % 3)::BIGINT AS printed_page,
  md5(CASE k % 4 WHEN 2 THEN 'plain first line' || chr(10) WHEN 3 THEN 'OTHER ' || (k + 40) || chr(10) ELSE '' END || 'body of ' || doc_id) AS md5 FROM p""",
    "header_census": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT 'first' AS place, ls[1] AS line FROM l WHERE len(ls) > 0 UNION ALL SELECT 'last', ls[-1] FROM l WHERE len(ls) > 0)
SELECT place, CASE WHEN regexp_matches(line, '^CHAPTER [0-9]+$') THEN 'chapter' WHEN regexp_matches(line, '^[A-Z][A-Z0-9&''(),.\- ]*[A-Z.)]\s+[0-9]{1,3}$') OR regexp_matches(line, '^[0-9]{1,3}\s+[A-Z][A-Z0-9&''(),.\- ]*[A-Z.)]$') THEN 'header'
  WHEN regexp_matches(line, '^[0-9]{1,3}$') THEN 'number' ELSE 'other' END AS shape, count(*) AS n FROM e GROUP BY ALL""",
    "extract_pages": r"""WITH h AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)+')) AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, k, regexp_replace(raw, '\s+$', '') AS text FROM l WHERE NOT regexp_matches(raw, '^\s*$') AND NOT regexp_matches(raw, '^\s*[0-9]{1,3}\s*$')),
n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM p),
s AS (SELECT n.*, words, regexp_matches(text, '[a-z]-$') AND coalesce(regexp_matches(nxt, '^\p{Ll}'), false) AS seam FROM n JOIN h USING (doc_id))
SELECT doc_id AS source, sum(length(text) - CASE WHEN seam AND NOT list_contains(words, regexp_extract(text, '([a-z]+)-$', 1) || '-' || regexp_extract(nxt, '^([a-z]+)', 1)) THEN 1 ELSE 0 END + CASE WHEN nxt IS NULL OR seam THEN 0 ELSE 1 END)::BIGINT AS n_chars, count(*) AS n_pages FROM s GROUP BY doc_id""",
    "rewrite_parse": rf"""WITH u AS (SELECT conv_id, turn, '1. "' || left(text, 40) || '"' || chr(10) || '2) ' || replace(text, '. ', chr(10) || '- ') || chr(10) || '* INTENT: ' || left(text, 60) || chr(10) || '3. 12' || chr(10) AS a FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, turn, list_transform(string_split(a, chr(10)), lambda x: [x, regexp_replace(x, '^\s*(?:[0-9]+[.)]|[-*•])\s*', '')]) AS ls FROM u),
i AS (SELECT conv_id, turn, list_filter(ls, lambda x: starts_with(x[2], 'INTENT:'))[1][2] AS tagged, list_filter(ls, lambda x: NOT starts_with(x[2], 'INTENT:') AND regexp_matches(x[1], '^\s*(?:[0-9]+[.)]|[-*•])\s*(.+)$')) AS own FROM l),
s AS (SELECT conv_id, turn, {_STRIP.format(x="substr(tagged, 8)")} AS said, list_transform(own, lambda y: {_STRIP.format(x="regexp_extract(y[1], '^" + chr(92) + "s*(?:[0-9]+[.)]|[-*•])" + chr(92) + "s*(.+)$', 1)")}) AS f FROM i),
c AS (SELECT conv_id, turn, said, list_filter(list_transform(f, lambda x: {_STRIP.format(x=_UNQUOTE)}), lambda x: x <> '' AND length(x) <= 200 AND regexp_matches(x, '\p{{L}}')) AS f FROM s),
r AS (SELECT conv_id, turn, said, list_slice(list_filter(f, lambda x, k: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = k), 1, 3) AS f FROM c)
SELECT conv_id, turn, CASE WHEN length(said) BETWEEN 1 AND 200 THEN said END AS intent, len(f)::BIGINT AS n, array_to_string(f, '|') AS rewrites FROM r""",
    "page_map": f"WITH {_PAGES} SELECT source, page_number, char_start, char_start + length(text) AS char_end, md5(text) AS md5, separator FROM o",
    "page_asof": f"""WITH {_PAGES}, n AS (SELECT source, sum(length(text) + length(separator))::BIGINT AS n FROM o GROUP BY source)
SELECT source, n AS n_chars, max(CASE WHEN char_start <= n // 2 THEN page_number END) AS page_middle, max(CASE WHEN char_start <= greatest(n // 2, n - 1) THEN page_number END) AS page_end FROM o JOIN n USING (source) GROUP BY source, n""",
    "page_invariants": f"""WITH {_PAGES},
w AS (SELECT *, char_start - CASE WHEN source % 7 = 0 AND page_number = 2 THEN CASE WHEN source % 2 = 0 THEN 1 ELSE char_start + 1 END ELSE 0 END AS a, char_start + length(text) AS b FROM o),
x AS (SELECT *, lead(a) OVER (PARTITION BY source ORDER BY page_number) AS nxt_a FROM w),
y AS (SELECT unnest([CASE WHEN b <= a THEN 'empty' END, CASE WHEN nxt_a < b THEN 'overlap' END, CASE WHEN length(text) <> b - a THEN 'length' END, CASE WHEN regexp_matches(text, '^\\n|\\n$') THEN 'untrimmed' END, CASE WHEN a < 0 THEN 'negative' END]) AS problem FROM x)
SELECT problem, count(*) AS n FROM y WHERE problem IS NOT NULL GROUP BY problem""",
    "line_census": rf"""WITH h AS (SELECT doc_id, (doc_id % 12) || '.' || (n_chars % 40) || CASE WHEN doc_id % 3 = 0 THEN '.' || (doc_id % 5) ELSE '' END || ' Heading' || chr(10) || coalesce(text, '') AS text FROM documents),
l AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM h), n AS (SELECT regexp_extract(line, '^([0-9]{{1,2}}(?:\.[0-9]{{1,3}})+)\b', 1) AS n FROM l)
SELECT len(string_split(n, '.')) AS depth, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(n))), 1, 8), ' ') AS examples FROM n WHERE n <> '' GROUP BY 1""",
    "repeated_lines": f"WITH {_LINES}, d AS (SELECT DISTINCT doc_id, line FROM l WHERE line <> '') SELECT line, count(*) AS pages FROM d GROUP BY line HAVING count(*) > 0.005 * (SELECT count(*) FROM documents)",
    "char_census": r"SELECT character, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F–—‘’“”•§£€…]')) AS character FROM documents) GROUP BY character",
    "page_coverage": r"""SELECT count(*) AS n_pages, sum((s = 0)::INT)::BIGINT AS n_no_text, 0::BIGINT AS n_image_only, sum((s > 0 AND s < 100)::INT)::BIGINT AS n_sparse, sum(h)::BIGINT AS n_hyphen_lines, sum(c)::BIGINT AS n_cid, sum(r)::BIGINT AS n_replacement
FROM (SELECT length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS s, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[a-z]-$'))) AS h, len(regexp_extract_all(text, '\(cid:[0-9]+\)')) AS c, len(regexp_extract_all(text, '�')) AS r FROM documents)""",
    "hyphen_attest": r"""WITH w AS (SELECT doc_id AS source, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)+'))) AS w FROM documents)
SELECT source, len(w)::BIGINT AS n_words, array_to_string(w, ' ') AS words FROM w WHERE len(w) > 0""",
    "html_text": _sql_html(),
    "sentence_split": _sql_sentences(),
    "citations_extract": f"WITH {ANSWERS} SELECT query_id, pos, para, page, raw FROM x",
    "sections_related": """WITH s AS (SELECT doc_id, (doc_id % 4)::VARCHAR || CASE WHEN doc_id % 3 > 0 THEN '.' || (doc_id % 13) ELSE '' END AS a, CASE WHEN doc_id % 7 = 0 THEN 'APPENDIX ' ELSE '' END || (doc_id % 2 * 2) || '.' || (doc_id % 26) AS b FROM documents)
SELECT doc_id, (b NOT LIKE 'APPENDIX%') AND (a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.')) AS related FROM s""",
    "grounding_gate": f"""WITH {ANSWERS} SELECT query_id, n_citations, n_grounded, gate_outcome,
  CASE gate_outcome WHEN 'REFUSAL' THEN 'refusal_shown' WHEN 'CITATIONS_VERIFIED' THEN 'shown' WHEN 'PARTIALLY_VERIFIED' THEN 'shown_with_warning' ELSE 'blocked_unverified' END AS action, gate_outcome <> 'CITATIONS_UNVERIFIED' AS is_shown FROM o""",
    "completeness": f"""WITH {ANSWERS},
k AS (SELECT *, CASE query_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS s, CASE query_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS cs FROM o)
SELECT lang, count(*) AS n_answers, 0::BIGINT AS n_errors, round(sum((gate_outcome = 'REFUSAL')::INT)::DOUBLE / count(*), 6) AS false_refusal_rate, round(sum((gate_outcome = 'CITATIONS_UNVERIFIED')::INT)::DOUBLE / count(*), 6) AS false_block_rate,
  round(sum(cs)::DOUBLE / nullif(sum(s), 0), 6) AS coverage, round(sum(n_grounded)::DOUBLE / nullif(sum(n_citations), 0), 6) AS grounded_rate,
  sum((gate_outcome = 'REFUSAL')::INT)::BIGINT AS n_refusal, sum((gate_outcome = 'CITATIONS_VERIFIED')::INT)::BIGINT AS n_citations_verified, sum((gate_outcome = 'PARTIALLY_VERIFIED')::INT)::BIGINT AS n_partially_verified, sum((gate_outcome = 'CITATIONS_UNVERIFIED')::INT)::BIGINT AS n_citations_unverified
FROM k GROUP BY lang""",
    "judge_agg": """WITH j AS (SELECT lang, CASE WHEN doc_id % 13 = 0 THEN 'api' WHEN doc_id % 17 = 0 THEN 'parse' END AS e, doc_id % 6 = 0 AS z, CASE WHEN quality = 1 THEN 1.0 ELSE 1.0 / 3 END AS f FROM labels JOIN documents USING (doc_id)),
s AS (SELECT lang, count(*) AS attempted, round(count(e)::DOUBLE / count(*), 6) AS failure_rate, sum((e IS NULL AND z)::INT)::BIGINT AS zero_claim, round(avg(CASE WHEN e IS NULL AND NOT z THEN f END)::DOUBLE, 6) AS f FROM j GROUP BY lang)
SELECT lang, attempted, failure_rate, zero_claim, failure_rate > 0.2 AS suppressed, CASE WHEN failure_rate <= 0.2 THEN f END AS faithfulness FROM s""",
    "audit_events": "SELECT event_id::VARCHAR AS event, sha256(props) AS query_sha256, length(props)::BIGINT AS query_chars, event_type AS action, length(event_type)::BIGINT AS answer_chars, user_id AS first_id, event_type AS locator FROM events",
    "chunk_ids": "SELECT doc_id, left(sha256(source || chr(0) || text), 16) AS chunk_id FROM documents",
    "dedup_first": "SELECT left(sha256(source || chr(0) || text), 16) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "page_sample": """WITH h AS (SELECT source, doc_id, sha256('7:' || doc_id) AS h FROM documents)
SELECT source, doc_id AS page_number, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS place FROM h) WHERE place <= 5""",
    "sync_diff": """WITH f AS (SELECT source, left(sha256(source || chr(0) || text), 16) AS id, min(doc_id) AS d FROM documents GROUP BY ALL)
SELECT source, sum((d % 7 = 3)::INT)::BIGINT AS added, sum((d % 7 = 2)::INT)::BIGINT AS updated, sum((d % 7 = 4)::INT)::BIGINT AS deleted FROM f GROUP BY source""",
}
