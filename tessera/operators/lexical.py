"""BM25 over a chunk table: a stored index in blocks of chunks, and scores of a batch of questions from it.

A block is one row: its chunks' keys and lengths, and for each of its terms the chunks that hold it and a bound of what it adds. A batch of questions
is dealt in blocks too; a task scores one pair of blocks as a product of two matrices and keeps that pair's best. So no
posting travels, whatever the terms' frequencies: a stop word costs no more than its entries in the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.sources.shared import held, shared_dir

#: Saturation, length weight, and the share of the mean idf that a negative idf becomes (fixed values).
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks and tokens of a block at most (a longer chunk is one alone); terms of a block of questions, about.
CHUNKS, TOKENS, TERMS = 2048, 1_000_000, 4096
#: So many (question, term) rows, about, are broadcast at a time; blocks of questions a task keeps at hand.
SMALL, HELD = 200_000, 8
#: Bytes of rows that a task's Python takes at a time (and a row): two blocks, about. Spark's own limit lets a task hold four times as much.
BATCH = 16 << 20
#: How blocks are stored: a task reads all that shares a row group at once, so a full block (3 MB as compressed, 8 MB as read) is a group by itself,
#: and small ones share one. Parquet would look at a group's size only after 100 rows, which are 800 MB of blocks; here it looks after each. Until a file
#: ends, its writer holds the least and largest value of each column and group, which would be the blocks themselves: nothing reads these.
GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.column.statistics.enabled": False}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends rows to Python in batches of BATCH bytes, however many a partition has. The setting counts when a plan runs,
    not when it is made."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n chunks and their mean number of tokens."""
    return chunks.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(term, df)."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weighed(df: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df) and one row (n): a negative idf becomes a share of the mean over all terms; 0 stays."""
    raw = df.join(F.broadcast(n.select("n"))).withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # n is one row
    mean = raw.agg((F.lit(EPSILON) * F.avg("idf0")).alias("floor"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") < 0, F.col("floor")).otherwise(F.col("idf0")).alias("idf"))


def term_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) of a chunk table."""
    return weighed(document_frequencies(chunks, text), corpus_stats(chunks, text))


_BLOCK = "id long, n long, total long, dl binary, terms array<string>, df array<int>, chunks binary, tf binary, tf_most binary, dl_least binary"


def _blocks(parts: Iterator[pa.RecordBatch], most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of chunks (what is kept of them, terms) as rows of blocks; each partition fills blocks of its own. Where rows have a
    group, which must come in order, a block holds rows of one group."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal made
        t = pa.Table.from_batches(held)
        terms = t["terms"].combine_chunks()
        dl = pc.list_value_length(terms).to_numpy()
        code = pc.dictionary_encode(terms.flatten())
        order = pc.sort_indices(code.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        pairs, tf = np.unique(place[code.indices.to_numpy()] * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
        pack = lambda x: [x.astype("<i4").tobytes()]
        row = {f.name: [t[f.name].to_pylist()] for f in schema if f.name.startswith("of_")}
        row |= {"id": [first + made], "n": [len(dl)], "total": [int(dl.sum())], "dl": pack(dl), "terms": [code.dictionary.take(order).to_pylist()]}
        row |= {"group": [t["group"][0].as_py()]} if "group" in t.column_names else {}
        df = np.bincount(pairs // len(dl), minlength=len(order))
        row |= {"df": [df.tolist()], "chunks": pack(pairs % len(dl)), "tf": pack(tf)}
        begins = np.cumsum(df) - df
        row |= {"tf_most": pack(np.maximum.reduceat(tf, begins) if len(tf) else tf), "dl_least": pack(np.minimum.reduceat(dl[pairs % len(dl)], begins) if len(tf) else tf)}
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in schema], schema=schema)

    waiting: list[pa.RecordBatch] = []
    rows = size = 0
    group = None
    for b in parts:
        begin = 0
        groups = b["group"].to_pylist() if "group" in b.schema.names else [None] * b.num_rows
        for k, (n, g) in enumerate(zip(pc.list_value_length(b["terms"]).to_pylist(), groups, strict=True)):
            if rows and (rows == most or size + n > TOKENS or g != group):
                yield block([*waiting, b.slice(begin, k - begin)])
                waiting, begin, rows, size = [], k, 0, 0
            rows, size, group = rows + 1, size + n, g
        waiting.append(b.slice(begin))
    if rows:
        yield block(waiting)


class _Questions:
    """A block of questions: its distinct questions and terms, and the weight of each term in each question."""

    def __init__(self, questions: pa.Array, terms: pa.Array, weights: np.ndarray) -> None:
        q, t = pc.dictionary_encode(questions), pc.dictionary_encode(terms)
        self.questions, self.terms = q.dictionary, t.dictionary
        self.weights = np.zeros((len(self.questions), len(self.terms)))
        np.add.at(self.weights, (q.indices.to_numpy(), t.indices.to_numpy()), weights)


def _part(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))


def _unpack(block: dict, c: str) -> np.ndarray:
    return np.frombuffer(block[c].as_py(), "<i4")


class _Hits:
    """The terms of a block of chunks that a block of questions asks for."""

    def __init__(self, block: dict, asked: _Questions, avgdl: float) -> None:
        at = pc.index_in(block["terms"].values, value_set=asked.terms)
        self.block, self.avgdl = block, avgdl
        self.hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        self.weights = asked.weights[:, at.take(pa.array(self.hit)).to_numpy(zero_copy_only=False).astype(int)]

    def most(self) -> np.ndarray:
        """What no chunk of the block can exceed, for each question: each term counts as where it is most frequent, in the
        shortest chunk that has it. Terms of negative weight count nothing."""
        return np.maximum(self.weights, 0) @ _part(_unpack(self.block, "tf_most")[self.hit], _unpack(self.block, "dl_least")[self.hit], self.avgdl)

    def scores(self, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores of the chunks of the block to six places) of those of some questions (rows) that can reach what they
        have to, with each term's largest part in the block."""
        dl, df = _unpack(self.block, "dl"), self.block["df"].values.to_numpy()
        begin, n = (np.cumsum(df) - df)[self.hit], df[self.hit]
        row = np.repeat(np.arange(len(self.hit)), n)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        chunk, tf = _unpack(self.block, "chunks")[entry], _unpack(self.block, "tf")[entry]
        parts = _part(tf, dl[chunk], self.avgdl)
        rows = rows[np.maximum(self.weights[rows], 0) @ np.maximum.reduceat(parts, np.cumsum(n) - n) >= least[rows] - 1e-6]
        part = np.zeros((len(self.hit), len(dl)))
        part[row, chunk] = parts
        return rows, np.round(self.weights[rows] @ part, 6)


def _best(parts: Iterator[pa.RecordBatch], avgdl: float, top_k: int, schema: pa.Schema, tally: tuple[Accumulator, Accumulator] | None = None) -> Iterator[pa.RecordBatch]:
    """The top_k of each question in each block of chunks, of rows that pair blocks with blocks of questions.

    A task keeps the top_k scores that each question has so far; a block that cannot reach the least of them is passed over
    for that question, and for all is not scored. tally counts pairs of a block and a question, and those that were scored.
    """
    built: dict[int, tuple[_Questions, np.ndarray]] = {}

    def questions(row: dict) -> tuple[_Questions, np.ndarray]:
        qb = row["qb"].as_py()
        if qb not in built:
            if len(built) == HELD:
                built.clear()
            made = _Questions(row["of_query"].values, row["of_term"].values, row["weights"].values.to_numpy())
            built[qb] = made, np.zeros((len(made.questions), top_k))
        return built[qb]

    for b in parts:
        rows_of = [{c: b[c][k] for c in b.schema.names} for k in range(b.num_rows)]
        bounds = [_Hits(row, questions(row)[0], avgdl).most() for row in rows_of]
        # Of the blocks that came together, the most promising go first: they raise what the others have to reach.
        for k in sorted(range(b.num_rows), key=lambda k: (rows_of[k]["qb"].as_py(), -bounds[k].sum())):
            row = rows_of[k]
            asked, tops = questions(row)
            least = tops.min(axis=1)
            rows = np.flatnonzero(bounds[k] >= np.maximum(least - 1e-6, 1e-9))  # scores are rounded, and equal ones go by key
            rows, s = _Hits(row, asked, avgdl).scores(rows, least) if len(rows) else (rows, None)
            if tally:
                tally[0].add(len(least))
                tally[1].add(len(rows))
            if not len(rows):
                continue
            if "allowed" in row:
                s = np.where(row["allowed"].values.to_numpy(zero_copy_only=False).astype(bool), s, 0.0)
            keys = row["of_key"].values
            kept = np.partition(s, s.shape[1] - top_k, axis=1)[:, s.shape[1] - top_k :] if s.shape[1] > top_k else s
            floor = kept.min(axis=1) if s.shape[1] > top_k else np.zeros(len(s))
            tops[rows] = -np.partition(-np.concatenate([tops[rows], kept], axis=1), top_k - 1, axis=1)[:, :top_k]
            out: tuple[list, list, list] = ([], [], [])
            for q in np.flatnonzero((s > 0).any(axis=1)).tolist():
                may = np.flatnonzero((s[q] > 0) & (s[q] >= max(floor[q], least[rows[q]])))
                for score, key in sorted(zip((-s[q][may]).tolist(), keys.take(pa.array(may)).to_pylist(), strict=True))[:top_k]:
                    out[0].append(int(rows[q]))
                    out[1].append(key)
                    out[2].append(-score)
            yield pa.RecordBatch.from_arrays([asked.questions.take(pa.array(out[0], pa.int64())), pa.array(out[1], schema.field(1).type), pa.array(out[2], pa.float64())], schema=schema)


def write_blocks(chunks: DataFrame, path: str, key: str, text: str = "text", keep: tuple[str, ...] = (), most: int = CHUNKS, group: Column | None = None) -> None:
    """Chunks in their order as blocks under a path; see _blocks."""
    own = chunks.select(F.col(key).alias("of_key"), *[F.col(c).alias(f"of_{c}") for c in keep], tokens(F.col(text)).alias("terms"), *([] if group is None else [group.alias("group")]))
    head = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in own.schema if f.name.startswith("of_"))
    layout = f"{head}, {_BLOCK}" + ("" if group is None else ", group long")
    schema = chunks.sparkSession.createDataFrame([], layout).toArrow().schema
    with small_batches(chunks.sparkSession):
        own.mapInArrow(lambda p: _blocks(p, most, schema), layout).write.options(**GROUPS).mode("overwrite").parquet(path)


class LexicalIndex:
    """A stored index under a path: blocks, terms (term, df, idf) and stats (n, avgdl). It is whole once it has its stats."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Open an index; a missing or unfinished one is an AnalysisException."""
        self.spark, self.path = spark, path
        self.blocks, self.terms = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms")
        self.n, self.avgdl = spark.read.parquet(f"{path}/stats").select("n", "avgdl").first()

    @classmethod
    def build(cls, chunks: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), most: int = CHUNKS) -> LexicalIndex:
        """Index chunks by their key; what an unfinished build left under the path is written anew. `keep` names columns that a search may filter by. Null texts count, without tokens."""
        spark = chunks.sparkSession
        write_blocks(chunks, f"{path}/blocks", key, text, keep, most)
        blocks = spark.read.parquet(f"{path}/blocks")
        total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
        counted = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).withColumnRenamed("terms", "term")
        weighed(counted, total).write.mode("overwrite").parquet(f"{path}/terms")
        total.write.mode("overwrite").parquet(f"{path}/stats")
        return cls(spark, path)

    def weights(self, asked: DataFrame, few: bool) -> DataFrame:
        """asked (term and other columns) with the idf of the terms that the index has; few: asked may be broadcast."""
        return self.terms.select("term", "idf").join(F.broadcast(asked) if few else asked, "term")

    def search(self, questions: DataFrame, top_k: int, where: Callable[[Column], Column] | None = None, key: str = "doc_id", question_key: str = "query_id", question: str = "question", tally: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
        """(question_key, key, score, rank) of the top_k positive scores of each question; ties go by key.

        `where` tells by a kept chunk's columns whether it is a candidate: statistics stay those of all chunks. A question's
        repeated tokens count each. The search runs when it is called, and what it found is held: a plan that reads it twice searches once.
        """
        asked = questions.select(question_key, F.explode(tokens(F.col(question))).alias("term")).groupBy(question_key, "term").agg(F.count("*").alias("qtf"))
        size = asked.count()
        n = max(1, -(-size // TERMS))
        of_term = self.weights(asked, size <= SMALL)
        own = of_term.select(F.pmod(F.xxhash64(question_key), F.lit(n)).cast("int").alias("qb"), F.struct(F.col(question_key).alias("q"), F.col("term").alias("t"), (F.col("qtf") * F.col("idf")).alias("w")).alias("a"))
        dealt = own.groupBy("qb").agg(F.collect_list("a").alias("a")).select("qb", F.col("a.q").alias("of_query"), F.col("a.t").alias("of_term"), F.col("a.w").alias("weights"))
        kept = [c for c in self.blocks.columns if c.startswith("of_") and c != "of_key"]
        gone = None if "gone" not in self.blocks.columns else F.transform("of_key", lambda k: F.coalesce(~F.array_contains("gone", k), F.lit(True)))
        chosen = None if where is None else F.transform(F.arrays_zip(*[F.col(c).alias(c[3:]) for c in kept]), lambda c: F.coalesce(where(c), F.lit(False)))
        allowed = [c for c in (gone, chosen) if c is not None]
        allowed = [(F.zip_with(*allowed, lambda a, b: a & b) if len(allowed) > 1 else allowed[0]).alias("allowed")] if allowed else []
        blocks = self.blocks.select("of_key", "dl", "terms", "df", "chunks", "tf", "tf_most", "dl_least", *allowed)
        kinds = (questions.schema[question_key].dataType, self.blocks.schema["of_key"].dataType.elementType)
        layout = f"{question_key} {kinds[0].simpleString()}, {key} {kinds[1].simpleString()}, score double"
        schema = self.spark.createDataFrame([], layout).toArrow().schema
        avgdl = self.avgdl
        # The index stays where it is: questions go to it, in as many broadcasts of bounded size as they need.
        rounds = max(1, -(-size // SMALL))
        dealt = dealt if rounds == 1 else held(dealt)
        pairs = [blocks.crossJoin(F.broadcast(dealt if rounds == 1 else dealt.where(F.col("qb") % rounds == r))) for r in range(rounds)]
        rank = F.row_number().over(Window.partitionBy(question_key).orderBy(F.desc("score"), key))
        found = [p.mapInArrow(lambda p: _best(p, avgdl, top_k, schema, tally), layout).withColumn("rank", rank).where(F.col("rank") <= top_k) for p in pairs]
        with small_batches(self.spark):
            return reduce(DataFrame.unionByName, [held(f) for f in found])


def bm25(chunks: DataFrame, questions: DataFrame, top_k: int, where: Column | None = None, key: str = "doc_id", text: str = "text", question_key: str = "query_id", question: str = "question") -> DataFrame:
    """LexicalIndex.search over an index made for this call in the shared folder; `where` is a condition on chunks."""
    spark = chunks.sparkSession
    path = f"{shared_dir(spark)}/bm25-{spark.sql('select uuid() as u').first()['u']}"
    own = chunks if where is None else chunks.withColumn("candidate_", F.coalesce(where, F.lit(False)))
    index = LexicalIndex.build(own, path, key, text, () if where is None else ("candidate_",))
    return index.search(questions, top_k, None if where is None else lambda c: c["candidate_"], key, question_key, question)
