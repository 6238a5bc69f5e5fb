"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytepairs
from tessera.llm.common import table
from tessera.llm.embedding import near_vectors
from tessera.llm.fingerprint import edit_likeness
from tessera.llm.importance import resample
from tessera.llm.jaccard import near_copies
from tessera.llm.language import fit, held_out, identify
from tessera.llm.license import UNKNOWN, scan
from tessera.llm.lm import whole_difference
from tessera.llm.packing import pack
from tessera.llm.pieces import encode
from tessera.llm.pii import BASE, joined, with_spans
from tessera.llm.reassembly import reassembled
from tessera.llm.warc import captures


def one_of(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans")
    base = F.filter("spans", lambda s: s["base"])
    count = [F.size(F.filter(base, one_of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(table(spark, sf_dir, "pages"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("paragraphs", lambda p: p["confirmed"] & (p["family"] != UNKNOWN))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",")
    best = F.coalesce(F.array_max(F.transform(sure, lambda p: p["probability"])), F.lit(0.0))
    return found.select("doc_id", names.alias("licenses"), F.size(sure).cast("long").alias("n_licensed"), F.size("paragraphs").cast("long").alias("n_paragraphs"), best.alias("score"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whole_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytepairs.decode(bytepairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_jaccard": op2_jaccard,
    "op3_pieces": op3_pieces,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_embeddings": op6_embeddings,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_lm": op10_lm,
    "op11_bytepairs": op11_bytepairs,
    "op12_reassembly": op12_reassembly,
    "op13_importance": op13_importance,
}

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {a}, 10))::BIGINT >> {s}) & 31)::INT, 1)"
_BASE32 = " || ".join(_DIGIT.format(a=10 * g + 1, s=35 - 5 * k) for g in range(4) for k in range(8))

#: CTE crc_table (t), and the CRC of bytes in hexadecimal by it.
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen({x}), 2), lambda k: ('0x' || substr({x}, k, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])))::BIGINT"

ORACLE: dict[str, str] = {
    "op12_reassembly": f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS src, text, {_CRC.format(x="x")} AS h FROM (SELECT *, hex(doc_id::VARCHAR) AS x FROM documents), crc_table),
o AS MATERIALIZED (SELECT doc_id, src, h // 100 % 300 AS key, CASE WHEN h % 23 <= 1 THEN 'commit' WHEN h % 23 = 2 THEN 'abort' WHEN h % 23 <= 4 THEN 'savepoint' WHEN h % 23 <= 6 THEN 'rollback' ELSE 'change' END AS op,
  CASE WHEN h % 23 > 6 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN (h // 100 % 300)::VARCHAR || ':' || text END AS kv FROM d),
x AS (SELECT *, coalesce(sum((op IN ('commit', 'abort'))::INT) OVER (PARTITION BY src ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn FROM o),
s AS (SELECT *, sum(CASE op WHEN 'savepoint' THEN 1 WHEN 'rollback' THEN -1 ELSE 0 END) OVER (PARTITION BY src, txn ORDER BY doc_id) AS total FROM x),
l AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY src, txn ORDER BY doc_id)) AS depth FROM s),
b AS MATERIALIZED (SELECT *, coalesce(lag(depth) OVER (PARTITION BY src, txn ORDER BY doc_id), 0) AS before FROM l),
e AS MATERIALIZED (SELECT src, txn, doc_id, op, CASE WHEN op = 'commit' THEN row_number() OVER (PARTITION BY op ORDER BY doc_id) END AS number FROM b WHERE op IN ('commit', 'abort')),
c AS MATERIALIZED (SELECT b.doc_id, b.key, b.kv, min(r.doc_id) AS undone, any_value(e.op) AS ended, any_value(e.doc_id) AS by_id, any_value((e.number - 1) // 4 + 1) AS epoch
  FROM b LEFT JOIN b r ON r.src = b.src AND r.txn = b.txn AND r.op = 'rollback' AND r.before = b.depth AND r.doc_id > b.doc_id LEFT JOIN e ON e.src = b.src AND e.txn = b.txn WHERE b.op = 'change' GROUP BY ALL),
p AS MATERIALIZED (SELECT epoch, key, arg_max({_CRC.format(x="x")}, (by_id, doc_id)) AS crc, arg_max(x <> '', (by_id, doc_id)) AS there FROM (SELECT *, hex(coalesce(kv, '')) AS x FROM c), crc_table WHERE undone IS NULL AND ended = 'commit' GROUP BY epoch, key),
q AS (SELECT DISTINCT (number - 1) // 4 + 1 AS epoch FROM e WHERE op = 'commit'),
k AS (SELECT q.epoch, p.key, arg_max(crc, p.epoch) AS crc, arg_max(there, p.epoch) AS there FROM q JOIN p ON p.epoch <= q.epoch GROUP BY q.epoch, p.key)
SELECT 'state' AS kind, q.epoch AS id, count(k.key) FILTER (there) AS n, coalesce(sum(crc) FILTER (there), 0)::BIGINT AS value FROM q LEFT JOIN k ON k.epoch = q.epoch GROUP BY q.epoch
UNION ALL SELECT CASE WHEN undone IS NULL THEN 'abort' ELSE 'rollback' END, doc_id, coalesce(undone, by_id), key FROM c WHERE undone IS NOT NULL OR ended IS DISTINCT FROM 'commit'""",
    "op13_importance": f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM d),
v AS MATERIALIZED (SELECT w, {_CRC.format(x="x")} % 10000 AS bucket FROM (SELECT w, hex(w) AS x FROM f UNION SELECT w, hex(w) FROM b), crc_table),
n AS MATERIALIZED (SELECT bucket, (SELECT count(*) FROM f) AS ss, (SELECT count(*) FROM b) AS tt, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM (SELECT w, 0 AS side FROM f UNION ALL SELECT w, 1 FROM b) JOIN v USING (w) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM n),
m AS (SELECT doc_id, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM f JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS MATERIALIZED (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= many * 10 // 100 THEN place END AS rank FROM k""",
    "op5_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN w ON p.html = w.html""",
    "op6_embeddings": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS s FROM e WHERE label IS NOT NULL AND v IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.v, b.v) / (a.s * b.s) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS w FROM e UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
SELECT c.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u) c
LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) k ON k.u = c.vec_id""",
    "op2_jaccard": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\t\n\v\f\r ]+') AS w FROM documents),
t AS MATERIALIZED (SELECT text, any_value(w) AS w, min(doc_id) AS id, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY text),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM t),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS u, b.id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
r AS (SELECT id AS u, id AS v FROM t UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
k AS (SELECT u, min(v) AS class_id FROM r GROUP BY u),
o AS (SELECT u, sum(copies)::BIGINT AS n FROM l JOIN t ON t.id = l.v GROUP BY u)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, (coalesce(o.n, 0) + coalesce(t.copies - 1, 0))::BIGINT AS n_links, d.doc_id = coalesce(class_id, d.doc_id) AS kept
FROM d LEFT JOIN t ON t.text = d.text LEFT JOIN k ON k.u = t.id LEFT JOIN o ON o.u = t.id""",
    "op10_lm": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\t\n\v\f\r ]+') AS w, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, t, generate_subscripts(w, 1) AS k, unnest(w) AS w FROM d),
v AS MATERIALIZED (SELECT w FROM p WHERE t GROUP BY w HAVING count(*) >= 2),
q AS MATERIALIZED (SELECT doc_id, t, k, v.w AS w FROM p LEFT JOIN v ON v.w = p.w),
b AS MATERIALIZED (SELECT doc_id, t, k, w, lag(w) OVER (PARTITION BY doc_id ORDER BY k) AS v FROM q),
one AS MATERIALIZED (SELECT w, count(*) AS nb, count(*) FILTER (t) AS na FROM q GROUP BY w),
two AS MATERIALIZED (SELECT v, w, count(*) AS nb, count(*) FILTER (t) AS na FROM b WHERE v IS NOT NULL GROUP BY v, w),
ctx AS MATERIALIZED (SELECT v, sum(nb) AS nb, sum(na) AS na FROM two GROUP BY v),
s AS (SELECT (SELECT count(*) FROM v) + 1 + count(*) AS sb, (SELECT count(*) FROM v) + 1 + count(*) FILTER (t) AS sa FROM q),
l AS (SELECT b.doc_id, -log2((coalesce(two.na, 0) + 5.0::DOUBLE * (one.na + 1) / sa) / (coalesce(ctx.na, 0) + 5.0)) AS a, -log2((coalesce(two.nb, 0) + 5.0::DOUBLE * (one.nb + 1) / sb) / (coalesce(ctx.nb, 0) + 5.0)) AS b
  FROM b JOIN one ON one.w IS NOT DISTINCT FROM b.w LEFT JOIN two ON two.v = b.v AND two.w IS NOT DISTINCT FROM b.w LEFT JOIN ctx ON ctx.v = b.v, s),
m AS (SELECT doc_id, count(*) AS n, avg(a) AS a, avg(b) AS b FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(a, 0), 6) AS target_loss, round(coalesce(b, 0), 6) AS background_loss, round(coalesce(a - b, 0), 6) AS score FROM d LEFT JOIN m USING (doc_id)""",
}
