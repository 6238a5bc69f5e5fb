"""Byte-level BPE: words by the tokenizer's pattern, ranked merges of their bytes, and decoding by joining the pieces' bytes.

Spark splits the texts. A slice of texts is encoded by its distinct words: those that are a piece have its rank; of the
others all of one length are merged together, a row of byte pieces each, whose least rank is merged at each step until none
is left. Ranks of neighbours are looked up in one table of all pairs that make a piece. `folded` is the same fold as an
expression of Spark's higher-order functions; it takes too long for whole corpora (see the README) and serves small tables.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pii import fresh

#: Ranks and pattern that the query uses; others may be given (fixed values of public_tokenizers).
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it; the engines' own \s differ.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: No pair of that rank; bytes from which on a word is merged alone; bytes of words, about, that are handled at a time.
NONE, LONG, SLICE = np.int32(2**31 - 1), 64, 8_000_000
_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), 20


def spelled(pattern: str) -> str:
    r"""The pattern with \s and \S written out, so that Java and Python match alike."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def read(path: str) -> list[bytes]:
    """The pieces of a file of ranks, by rank."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    pieces = {int(b): base64.b64decode(a) for a, b in rows}
    if sorted(pieces) != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [pieces[k] for k in range(len(pieces))]


class BytePairs:
    """Ranks, and for each pair of pieces that makes a piece the rank of that."""

    def __init__(self, path: str) -> None:
        self.list = read(path)
        self.rank = {p: k for k, p in enumerate(self.list)}
        self.pieces = pa.array(self.list, pa.binary())
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        made = {}
        for p, k in self.rank.items():
            for x in range(1, len(p)):
                a, b = self.rank.get(p[:x]), self.rank.get(p[x:])
                if a is not None and b is not None:
                    made[a << 32 | b] = k
        self.keys, self.values = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, NONE, np.int32)
        if len(made) > len(self.keys) // 2:
            raise ValueError("too many pieces for the table of pairs")
        keys, values = np.fromiter(made, np.int64, len(made)), np.fromiter(made.values(), np.int32, len(made))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each pair of neighbours makes, or NONE."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (self.keys[at[left]] >= 0)]
        return out

    def fold(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of byte pieces of one length; yields (rows, ids) as rows have nothing left to merge."""
        row = np.arange(len(ids))
        ranks = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            if not ranks.shape[1]:
                yield row, ids
                return
            at = ranks.argmin(axis=1)  # of equal ranks the leftmost
            least = ranks[np.arange(len(row)), at]
            ended = least == NONE
            if ended.any():
                yield row[ended], ids[ended]
                row, ids, ranks, at, least = (x[~ended] for x in (row, ids, ranks, at, least))
                if not len(row):
                    return
            k, (n, width) = np.arange(len(row)), ids.shape
            keep = np.ones((n, width), bool)
            keep[k, at + 1] = False
            ids[k, at] = least
            ids = ids[keep].reshape(n, width - 1)
            keep = keep[:, 1:]
            ranks = ranks[keep].reshape(n, width - 2)
            for x, there in ((at - 1, at > 0), (at, at < width - 2)):
                k = np.flatnonzero(there)
                ranks[k, x[k]] = self.merged(ids[k, x[k]], ids[k, x[k] + 1])

    def alone(self, word: bytes) -> np.ndarray:
        """The ids of a long word: its pairs wait in a heap by rank and place, so that time hardly grows with its length."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank.get
        pair = lambda a, b: get(self.list[a] + self.list[b])
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := pair(ids[k], ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = r, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (s := pair(r, ids[after[k]])) is not None:
                    heapq.heappush(heap, (s, k, r, ids[after[k]]))
            if (p := before[k]) >= 0 and (s := pair(ids[p], r)) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, their number for each word) of distinct words (binary)."""
        own = pc.index_in(words, value_set=self.pieces)
        known = own.is_valid().to_numpy(zero_copy_only=False)
        count = np.ones(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(known), own.drop_null().to_numpy().astype(np.int32)[:, None])]
        size = pc.binary_length(words).to_numpy()
        for n in np.unique(size[~known]).tolist():
            at = np.flatnonzero(~known & (size == n))
            if n > LONG:
                found += [(at[k : k + 1], self.alone(w)[None, :]) for k, w in enumerate(words.take(pa.array(at)).to_pylist())]
                continue
            flat = np.frombuffer(b"".join(words.take(pa.array(at)).to_pylist()), np.uint8)
            found += [(at[rows], ids) for rows, ids in self.fold(self.of_byte[flat.reshape(len(at), n)])]
        for at, ids in found:
            count[at] = ids.shape[1]
        begin, out = np.cumsum(count) - count, np.empty(count.sum(), np.int32)
        for at, ids in found:
            out[begin[at][:, None] + np.arange(ids.shape[1])] = ids
        return out, count

    def encode(self, split: pa.ListArray) -> pa.ListArray:
        """The ids of texts that are given as lists of words."""
        code = pc.dictionary_encode(split.flatten())
        flat, count = self.words(code.dictionary.cast(pa.binary()))
        number = code.indices.to_numpy()
        begin, n = (np.cumsum(count) - count)[number], count[number]
        ids = flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        sizes = pc.list_value_length(split).to_numpy()
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of lists of ids."""
        joined = self.pieces.take(ids.flatten())
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())]]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), joined.buffers()[2]])


_LOADED: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The ranks of a path, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def _runs(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of lists of about SLICE / 8 elements together; a longer one is alone."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLICE // 8, "right")))
        yield begin, end
        begin = end


def _over(docs: DataFrame, column: str, new: str, kind: str, work: str, path: str, pattern: str, text: str = "") -> DataFrame:
    """docs, with what the named method makes of lists in `column` in its place, as `new`."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = load(path), regex.compile(spelled(pattern))
        for b in parts:
            lists = b[column]
            if text and lists.null_count:  # texts with characters that Java's tables lack
                odd = pa.array([words.findall(t) for t in b[text].filter(lists.is_null()).to_pylist()], lists.type)
                here = lists.is_valid().to_numpy(zero_copy_only=False)
                place = np.where(here, np.cumsum(here) - 1, here.sum() + np.cumsum(~here) - 1)
                lists = pa.concat_arrays([lists.drop_null(), odd]).take(pa.array(place))
            keep = [c for c in b.schema.names if c != column]
            for x, y in _runs(lists):
                made = getattr(own, work)(lists.slice(x, y - x))
                yield pa.RecordBatch.from_arrays([*[b[c].slice(x, y - x) for c in keep], made], names=[*keep, new])

    return docs.mapInArrow(run, docs.drop(column, new).withColumn(new, F.lit(None).cast(kind)).schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs with `ids` (array<int>), replaced where docs has such a column.

    A null or empty text has no ids; repeated rows have theirs each; an empty table gives no rows; other columns stay,
    whatever their names. Texts are encoded whole, in time about as their length, also where they have no blanks: a word of
    up to 64 bytes is merged with those of its length, a longer one alone. Special tokens are ordinary text. path must be readable on all executors.
    """
    (words,) = fresh(docs, "bytepairs", "words")
    # Characters that Java does not know yet may be letters: such texts are split in the task.
    split = F.when(F.col(text).rlike(r"\p{Cn}"), F.lit(None)).otherwise(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(spelled(pattern)), F.lit(0)))
    return _over(docs.drop(*{ids} - {text}).withColumn(words, split), words, ids, "array<int>", "encode", path, pattern, text)


def decode(docs: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str = RANKS) -> DataFrame:
    """docs with `decoded` (binary: the pieces' bytes, joined), replaced where docs has such a column; null ids count as none."""
    (held,) = fresh(docs, "bytepairs", "ids")
    none = F.array().cast("array<int>")
    return _over(docs.drop(decoded).withColumn(held, F.coalesce(ids, none)), held, decoded, "binary", "decode", path, PATTERN)


def folded(word: Column, path: str = RANKS) -> Column:
    """The ids (array<int>) of one word (binary, not null) as an expression: a fold of ranked merges over its bytes by higher-order functions,
    with a literal rank map in 2^16 buckets by CRC. It takes some 200 microseconds a word."""
    slots: list[list[str]] = [[] for _ in range(1 << 16)]
    ranks: list[list[int]] = [[] for _ in range(1 << 16)]
    import zlib

    for k, p in enumerate(read(path)):
        slots[zlib.crc32(p) & 65535].append(base64.b64encode(p).decode())
        ranks[zlib.crc32(p) & 65535].append(k)
    names, values = F.from_json(F.lit(json.dumps(slots)), "array<array<binary>>"), F.from_json(F.lit(json.dumps(ranks)), "array<array<int>>")
    none, no_ranks = F.lit(int(NONE)), F.array().cast("array<int>")
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    place = lambda a, x: F.array_position(a, x).cast("int")
    rank = lambda b: let(F.crc32(b).bitwiseAND(65535).cast("int"), lambda s: F.coalesce(F.get(F.get(values, s), place(F.get(names, s), b) - 1), none))

    def merge(s: Column, at: Column) -> Column:
        p, r, n = s["p"], s["r"], F.size(s["p"])
        beside = lambda q: (F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), q)))).otherwise(no_ranks), F.when(at + 1 < n, F.array(rank(F.concat(q, F.get(p, at + 1))))).otherwise(no_ranks))
        new = lambda q: F.struct(F.concat(F.slice(p, F.lit(1), at - 1), F.array(q), F.slice(p, at + 2, n)).alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), *beside(q), F.slice(r, at + 2, n)).alias("r"))
        return let(F.concat(F.get(p, at - 1), F.get(p, at)), new)

    def step(s: Column, _: Column) -> Column:
        return let(F.array_min(s["r"]), lambda least: F.when(F.coalesce(least, none) < none, let(place(s["r"], least), lambda at: merge(s, at))).otherwise(s))

    def fold(p: Column) -> Column:
        pairs = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda k: rank(F.concat(F.get(p, k), F.get(p, k + 1))))).otherwise(no_ranks)
        return F.transform(F.aggregate(p, F.struct(p.alias("p"), pairs.alias("r")), step)["p"], rank)

    whole = rank(word)
    letters = F.when(F.octet_length(word) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda k: F.substring(word, k, F.lit(1)))).otherwise(F.array().cast("array<binary>"))
    return F.when(whole < none, F.array(whole)).otherwise(let(letters, fold))
