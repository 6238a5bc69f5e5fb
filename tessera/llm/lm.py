"""Cross-entropy difference of two matched n-gram models (Moore and Lewis).

The target model counts the words and word pairs of the documents given as target, the background model those of all
documents. They share one vocabulary (words that occur twice in the target, others being one unknown word) and every pair
that begins with a word of it (its follower may be the unknown word), so each word's followers add up to its context
total; both interpolate pairs with words. A document's score is the mean over its words of the target loss minus the
background loss, in bits: the lower, the more it is like the target.

All counts cover all documents and are exact, and no table of counts or words goes to every task or to the driver.
Documents are written once in chunks of bounded volume, bucketed by chunk, and stay where they are. A chunk asks for its
distinct n-grams by packed messages to hash ranges; a range adds up what all chunks sent and answers each in the order
of its request with what the others hold, so an answer needs no key. Its checksum must be that of the keys it answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, slices, word_hashes
from tessera.sources.shared import shared_dir

#: Least count in the target; weight of the words in a pair's probability; up to so many target ids are broadcast.
LEAST, WEIGHT, FEW_IDS = 2, 5.0, 500_000
#: Characters of a chunk (a longer text is one alone), and characters that a hash range answers for, about.
CHUNK, RANGE = 16_000_000, 64_000_000
#: Spark's bound on buckets.
MOST_BUCKETS = 100_000
#: Keys of the unknown word, and of any follower (of which a word's context total is the count).
_UNKNOWN, _ANY = np.uint64(2), np.uint64(3)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{_unique(df)}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _unique(df: DataFrame) -> str:
    return df.sparkSession.sql("select uuid() as u").first()["u"].replace("-", "")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df, written to the shared folder in buckets of its chunks and read again; the catalog forgets it at once."""
    spark, name = df.sparkSession, f"lm_chunks_{_unique(df)}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table the files stay
    return read


def _chunked(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk: that of the task, and a running one."""
    from pyspark import TaskContext

    chunk, held = TaskContext.get().partitionId() << 32, 0
    for b in parts:
        size = np.cumsum(b["n"].to_numpy(zero_copy_only=False)) + held
        step = size // most
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk + step, pa.int64()), "doc_id": b["doc_id"], "text": b["text"], "target": b["target"]})
        held = int(size[-1]) if len(size) else held


class Words:
    """The words of a chunk's documents: keys, the document of each, whether it is of the target, and the distinct keys."""

    def __init__(self, texts: list[str], target: np.ndarray) -> None:
        found = [(h, of + x) for x, y in slices(texts) for h, of in [word_hashes([t.lower() for t in texts[x:y]])]]
        key = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        self.key = np.maximum(key, np.uint64(4))
        self.of = np.concatenate([of for _, of in found]) if found else np.zeros(0, np.int64)
        self.mine = target[self.of]
        self.asked = Asked(self.key, self.mine)

    def pairs(self, known: np.ndarray) -> tuple[Asked, np.ndarray, np.ndarray]:
        """What is asked of pairs and contexts, and the positions of the words after a known one and of their contexts
        among the distinct keys. known: whether each distinct key is in the vocabulary."""
        sure = known[self.asked.place]
        word = np.where(sure, self.key, _UNKNOWN)
        at = np.flatnonzero((self.of[1:] == self.of[:-1]) & sure[:-1]) + 1
        before = mix(self.key[at - 1] * np.uint64(3) + np.uint64(29))
        asked = Asked(np.r_[mix(before + word[at]), mix(before + _ANY)], np.r_[self.mine[at], self.mine[at]])
        return asked, at, asked.place


class Asked:
    """Distinct keys in order, the count of each in all documents and in the target, and the place of each given key."""

    def __init__(self, key: np.ndarray, mine: np.ndarray) -> None:
        order = np.argsort(key)
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)]
        at = np.flatnonzero(first)
        self.place = np.empty(len(key), np.int64)
        self.place[order] = np.cumsum(first) - 1
        self.keys = key[at]
        self.n = np.diff(np.r_[at, len(key)])
        self.m = np.add.reduceat(mine[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)

    def messages(self, chunk: int, ranges: int) -> Iterator[tuple]:
        """(part, chunk, n, body) for each hash range that some keys are in; ranges follow the order of keys."""
        part = ((self.keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True][: len(part) + 1]) if len(part) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            keys = self.keys[x:y]
            yield int(part[x]), chunk, int(y - x), _packed(np.r_[keys[:1], np.diff(keys)], self.n[x:y], self.m[x:y])

    def answered(self, answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys over all chunks, in all documents and in the target."""
        own = sorted((r for r in answers.select(["kind", "part", "n", "check", "body"]).to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
        if sum(r["n"] for r in own) != len(self.keys) or np.bitwise_xor.reduce(np.array([r["check"] for r in own], np.int64), initial=0) != _check(self.keys):
            raise RuntimeError("the answers are not those to the questions of this chunk")
        got = [_unpacked(r["body"], r["n"], 2) for r in own]
        return tuple(mine + (np.concatenate([g[k] for g in got]).view(np.int64) if got else 0) for k, mine in enumerate((self.n, self.m)))


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(keys), initial=np.uint64(0)).view(np.int64))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, byte by byte of all values, compressed."""
    flat = np.concatenate([c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.ravel() for c in columns])
    return pa.compress(flat.tobytes(), "zstd", asbytes=True)


def _unpacked(body: bytes, n: int, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(body, 8 * n * columns, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in flat]


_MESSAGE = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_MESSAGES = "part int, chunk long, n long, body binary"
_ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("check", pa.int64()), ("body", pa.binary()), *((c, pa.int64()) for c in ("size", "all_b", "all_a", "known_b", "known_a"))])
_ANSWERS = "kind int, chunk long, part int, n long, check long, body binary, size long, all_b long, all_a long, known_b long, known_a long"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_WORDS, _PAIRS = 0, 1


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _texts(t: pa.Table | pa.RecordBatch) -> Words:
    return Words([x or "" for x in t.column("text").to_pylist()], t.column("target").to_numpy(zero_copy_only=False).astype(bool))


def _word_messages(parts: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """What the chunks of a partition ask of words; rows of a chunk follow each other."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        return _rows(list(_texts(pa.Table.from_batches(held)).asked.messages(held[0]["chunk"][0].as_py(), ranges)), _MESSAGE)

    for b in parts:
        chunk = b["chunk"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]).tolist() if len(chunk) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if held and held[0]["chunk"][0].as_py() != chunk[x]:
                yield flush()
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield flush()


def _answers(parts: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """The answers of each hash range to its messages, which come sorted by range and chunk; of words also the size of
    the vocabulary and the number of all words and of known ones."""
    rows = (r for b in parts for r in zip(*(b[c].to_pylist() for c in ("part", "chunk", "n", "body")), strict=True))
    for part, own in groupby(rows, lambda r: r[0]):
        sent = []
        for chunk, same in groupby(own, lambda r: r[1]):
            cols = [_unpacked(r[3], r[2], 3) for r in same]
            keys, n, m = (np.concatenate(c) for c in zip(*((np.cumsum(k), n, m) for k, n, m in cols), strict=True))
            if len(cols) > 1:  # a chunk that was read in two tasks
                order = np.argsort(keys, kind="stable")
                keys, n, m = keys[order], n[order], m[order]
                at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, n, m = keys[at], np.add.reduceat(n, at), np.add.reduceat(m, at)
            sent.append((chunk, keys, n, m))
        keys, n, m = (np.concatenate([s[k] for s in sent]) for k in (1, 2, 3))
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]])
        all_n, all_m = np.add.reduceat(n[order], at), np.add.reduceat(m[order], at)
        place = np.empty(len(keys), np.int64)
        place[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(keys)]))
        rest_n, rest_m = all_n[place] - n, all_m[place] - m
        known = all_m >= LEAST
        if kind == _WORDS:
            rest_n[~known[place]] = 0  # of unknown words only their sum matters
            sums = (int(known.sum()), int(all_n.sum()), int(all_m.sum()), int(all_n[known].sum()), int(all_m[known].sum()))
            yield _rows([(kind, None, part, 0, 0, b"", *sums)], _ANSWER)
        begin = 0
        for chunk, own_keys, *_ in sent:
            end = begin + len(own_keys)
            yield _rows([(kind, chunk, part, end - begin, _check(own_keys), _packed(rest_n[begin:end], rest_m[begin:end]), *[None] * 5)], _ANSWER)
            begin = end


def _known(words: Words, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, a = words.asked.answered(answers, _WORDS)
    return a >= LEAST, b, a


def _pair_messages(docs: pa.Table, answers: pa.Table, ranges: int) -> pa.Table:
    """What a chunk asks of pairs and contexts."""
    if not docs.num_rows:
        return pa.Table.from_batches([], _MESSAGE)
    words = _texts(docs)
    asked = words.pairs(_known(words, answers)[0])[0]
    return pa.Table.from_batches([_rows(list(asked.messages(docs["chunk"][0].as_py(), ranges)), _MESSAGE)])


def _scored(docs: pa.Table, answers: pa.Table, unknown: tuple[float, float], scale: tuple[float, float]) -> pa.Table:
    """Scores of a chunk's documents. unknown: the number of unknown words in target and background; scale: what the count
    of a word is divided by."""
    words = _texts(docs)
    known, word_b, word_a = _known(words, answers)
    asked, at, place = words.pairs(known)
    counts = asked.answered(answers, _PAIRS)
    n = np.bincount(words.of, minlength=docs.num_rows)
    mean = []
    for word, pair, others, total in ((word_a, counts[1], unknown[0], scale[0]), (word_b, counts[0], unknown[1], scale[1])):
        p = ((np.where(known, word, others) + 1) / total)[words.asked.place]
        both, context = pair[place[: len(at)]], pair[place[len(at) :]]
        p[at] = (both + WEIGHT * p[at]) / (context + WEIGHT)
        mean.append(np.bincount(words.of, -np.log2(p), docs.num_rows) / np.maximum(n, 1))
    return pa.table({"doc_id": docs["doc_id"], "n_tokens": n, "target_loss": mean[0], "background_loss": mean[1], "score": mean[0] - mean[1]})


def whole_difference(docs: DataFrame, target_ids: DataFrame, chunk: int = CHUNK, span: int = RANGE) -> DataFrame:
    """One row per document: doc_id, n_tokens, mean loss of both models and their difference (score).

    target_ids holds the doc_ids of the target; null and unknown ids there mean nothing. Words are lower-case runs
    without ASCII white space. After an unknown word, and at first, a word has its own probability alone. A null, empty
    or blank text has no tokens, losses 0 and score 0. Repeated rows are counted and scored each; other columns play no
    part. Without target documents every word is unknown to both models. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = target_ids.select(F.col("doc_id").alias("target_")).where("target_ is not null").distinct().withColumn("target", F.lit(True))
    few = ids.count() <= FEW_IDS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    volume = own.agg(F.sum("n")).first()[0] or 0
    ranges = max(n, -(-volume // span))
    flagged = own.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("target_"), "left").select("doc_id", "text", "n", F.coalesce("target", F.lit(False)).alias("target"))
    rows = flagged.mapInArrow(lambda p: _chunked(p, chunk), "chunk long, doc_id long, text string, target boolean")
    held = _bucketed(rows, min(MOST_BUCKETS, max(n, -(-volume // chunk))))

    def answers(messages: DataFrame, kind: int) -> DataFrame:
        return messages.repartition(ranges, "part").sortWithinPartitions("part", "chunk").mapInArrow(lambda p: _answers(p, kind), _ANSWERS)

    words = kept(answers(held.mapInArrow(lambda p: _word_messages(p, ranges), _MESSAGES), _WORDS), "lm-words")
    sums = words.agg(*(F.sum(c).alias(c) for c in ("size", "all_a", "all_b", "known_a", "known_b"))).first()
    size, all_a, all_b, known_a, known_b = (x or 0 for x in sums)
    unknown, scale = (float(all_a - known_a), float(all_b - known_b)), (float(all_a + size + 1), float(all_b + size + 1))
    told = words.where("chunk is not null")
    by_chunk = held.groupBy("chunk")
    pairs = answers(by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(lambda d, a: _pair_messages(d, a, ranges), _MESSAGES), _PAIRS)
    return by_chunk.cogroup(told.unionByName(pairs).groupBy("chunk")).applyInArrow(lambda d, a: _scored(d, a, unknown, scale), _SCORES)
