"""SentencePiece encoding by a batched Viterbi search, and decoding.

The distinct words of a batch are grouped by length, and all words of a length advance together: at each position the
hashes of all substrings ending there probe the sorted keys of the pieces of that length, and vectorised maxima keep
the best score and the length of the piece that led there. Normalisation is the identity with a dummy prefix, as in
the models this is for; what no piece covers falls back to bytes.

Pieces of unigram models add up their scores. Pieces of merge models have ranks instead, and a segmentation is the one
that merging gives exactly if each two neighbours are what merging makes of them together; so every prefix has one last
piece, and a step scores 0 if the pair of the piece and the last one before it is stable, else minus infinity.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, slices

#: The model of public pieces that the query uses; another path may be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words, and ids of words, that a process keeps from one slice of texts to the next; the store is emptied when it is full.
KNOWN, KEPT = 400_000, 4_000_000
#: Longer words are cut where no piece crosses; words of this length that have few like them go one by one.
LONG, ALONE, FEW = 64, 256, 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.uint64((1 << 18) - 1)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def is_merge_model(raw: bytes) -> bool:
    """Whether a serialised model's trainer_spec (field 2) has the model_type (field 3) of merges (2)."""

    def number(k: int) -> tuple[int, int]:
        v = shift = 0
        while True:
            v |= (raw[k] & 127) << shift
            shift, k = shift + 7, k + 1
            if raw[k - 1] < 128:
                return v, k

    def fields(k: int, end: int) -> Iterator[tuple[int, int, int]]:
        while k < end:
            tag, k = number(k)
            if tag & 7 in (1, 5):
                k += 8 if tag & 7 == 1 else 4
                continue
            v, k = number(k)
            yield tag, v, k
            k += v if tag & 7 == 2 else 0

    return any(t == 3 << 3 and v == 2 for tag, n, k in fields(0, len(raw)) if tag == 2 << 3 | 2 for t, v, _ in fields(k, k + n))


class Pieces:
    """The pieces of a model: sorted keys, ids and scores by length; byte pieces; the bytes of each piece."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        special = [model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(len(names))]
        if any(SPACE in n.lstrip(SPACE) for n, s in zip(names, special, strict=True) if not s):
            raise ValueError("pieces that cross words are not supported")
        self.byte_ids = np.full(256, model.unk_id(), np.int32)
        self.bytes: list[bytes] = []
        for k, n in enumerate(names):
            if model.is_byte(k):
                self.byte_ids[int(n[3:-1], 16)] = k
                self.bytes.append(bytes([int(n[3:-1], 16)]))
            else:
                self.bytes.append(b"" if model.is_control(k) else " ⁇ ".encode() if model.is_unknown(k) else n.replace(SPACE, " ").encode())
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        normal = [k for k, s in enumerate(special) if not s]
        score = np.array([model.get_score(k) for k in range(len(names))])
        self.unknown = float(score[normal].min()) - 10.0
        for n in sorted({len(names[k]) for k in normal}):
            own = [k for k in normal if len(names[k]) == n]
            keys = self.prefixes(_codes([names[k] for k in own]))[:, n]
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one key")
            self.by_length[n] = keys[order], np.array(own, np.int32)[order], score[np.array(own)[order]]
        # A map of the low bits of the keys of each length: most substrings are no piece, and need no search.
        self.may = {n: np.bincount((keys & _LOW).astype(np.int64), minlength=int(_LOW) + 1) > 0 for n, (keys, _, _) in self.by_length.items()}
        self.pairs = np.zeros(1 << 21, np.int64)
        self.clear()
        both = {n[k : k + 2] for k2 in normal for n in [names[k2]] for k in range(len(n) - 1)}
        self.crossed = np.sort(np.array([ord(x[0]) << 21 | ord(x[1]) for x in both], np.int64))
        self.names = {names[k]: k for k in normal}
        self.scores = score.tolist()
        self.power = np.array([pow(int(_BASE), k, 2**64) for k in range(2 * max(self.by_length) + 1)], np.uint64)
        with open(path, "rb") as f:
            self.merges = is_merge_model(f.read())
        if self.merges:
            self.score = {names[k]: (score[k], k) for k in normal}
            size = np.array([len(n) for n in names])
            self.size, self.key = size, np.zeros(len(names), np.uint64)
            for keys, ids, _ in self.by_length.values():
                self.key[ids] = keys
            self.rank = np.full(len(names), -1)
            ranked = sorted((k for k in normal if size[k] > 1), key=lambda k: (-score[k], k))
            self.rank[ranked] = np.arange(len(ranked))
            self.left, self.right = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
            for k in ranked:
                made = self.merged(names[k], names[k])
                if len(made) == 2 and all(m in self.score for m in made):
                    self.left[k], self.right[k] = (self.score[m][1] for m in made)
                else:
                    self.rank[k] = -1  # never made by merging

    def merged(self, word: str, but: str = "") -> list[str]:
        """The pieces that merging makes of a word, best score and leftmost first; never makes `but`."""
        text = list(word)
        after, ahead = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(text) and (both := text[a] + text[b]) in self.score and both != but:
                heapq.heappush(heap, (-self.score[both][0], a, both))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a]
            if not text[a] or b >= len(text) or text[a] + text[b] != both:
                continue
            text[a], text[b], after[a] = both, "", after[b]
            if after[a] < len(text):
                ahead[after[a]] = a
            offer(ahead[a], a)
            offer(a, after[a])
        return [t for t in text if t]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs are stable; answers are kept in a table of fixed size, where a later pair takes the place."""
        pair = (a.astype(np.int64) + 2 << 32) | (b.astype(np.int64) + 2)
        at = (mix(pair.view(np.uint64)) & np.uint64(len(self.pairs) - 1)).astype(np.int64)
        new = np.flatnonzero(self.pairs[at] >> 1 != pair)
        out = (self.pairs[at] & 1).astype(bool)
        if len(new):
            out[new] = self.settled(a[new], b[new])
            self.pairs[at[new]] = (pair[new] << 1) | out[new]
        return out

    def settled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b apart when they meet; negative ids stand for what never merges.

        Goes back in time: the later made of the two is taken apart, and the pair must not have been merged before that.
        """
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b, limit = a[at], b[at], np.full(len(at), 1 << 40)
        while len(at):
            both = np.full(len(at), 1 << 41)
            h, n = self.key[a] * self.power[self.size[b]] + self.key[b], self.size[a] + self.size[b]
            for k in np.unique(n):
                if k in self.by_length:
                    keys, ids, _ = self.by_length[k]
                    own = np.flatnonzero(n == k)
                    own = own[self.may[k][h[own] & _LOW]]
                    x = np.minimum(np.searchsorted(keys, h[own]), len(keys) - 1)
                    hit = keys[x] == h[own]
                    both[own[hit]] = self.rank[ids[x[hit]]]
            bad = (both >= 0) & (both < limit)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the prefixes of rows of code points; substrings follow by subtraction."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        v = mix(codes.astype(np.uint64) + np.uint64(77))
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + v[:, k]
        return out

    def clear(self) -> None:
        """Empty the store of known words: their number, and the begin and count of its ids in the pool."""
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, word: str) -> list[str]:
        """Parts of a long word: it is cut between characters that are neighbours in no piece, which nothing crosses."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.crossed, pair), len(self.crossed) - 1)
        ends = [0, *(np.flatnonzero(self.crossed[at] != pair) + 1).tolist(), len(word)]
        return [word[x:y] for x, y in zip(ends, ends[1:], strict=False)]

    def spelled(self, c: str) -> np.ndarray:
        return self.byte_ids[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)]

    def alone(self, word: str) -> list[int]:
        """The ids of one long word: the same search, position by position; which pairs are stable is found out at once
        for all pieces that meet somewhere in it."""
        names, longest = self.names, max(self.by_length)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]  # of each position the pieces that end there, longest first
        for e in range(1, len(word) + 1):
            for k in range(min(longest, e), 0, -1):
                i = names.get(word[e - k : e])
                if i is not None and (not self.merges or k == 1 or self.rank[i] >= 0):
                    ends[e].append((k, i))
        if self.merges:
            meet = {(i, j) for e in range(1, len(word) + 1) for k, j in ends[e] for _, i in ends[e - k]}
            a, b = (np.array(x, np.int64) for x in (zip(*meet, strict=True) if meet else ((), ())))
            apart = {p for p, ok in zip(zip(a.tolist(), b.tolist(), strict=True), self.settled(a, b).tolist(), strict=True) if ok} if meet else set()
        best, last = [0.0] * (len(word) + 1), [(1, -1)] * (len(word) + 1)
        for e in range(1, len(word) + 1):
            top = -np.inf
            for k, i in ends[e]:
                if self.merges:
                    before = last[e - k][1]
                    if before < 0 or (before, i) in apart:
                        last[e], top = (k, i), 0.0
                        break
                elif (x := best[e - k] + self.scores[i]) > top:
                    last[e], top = (k, i), x
            if not ends[e] or ends[e][-1][0] > 1:
                x = 0.0 if self.merges else best[e - 1] + self.unknown
                if x > top:
                    last[e], top = (1, -1), x
            best[e] = 0.0 if self.merges else top
        out, e = [], len(word)
        while e:
            k, i = last[e]
            out.append([i] if i >= 0 else self.spelled(word[e - 1]).tolist())
            e -= k
        return [i for ids in reversed(out) for i in ids]

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words that are better off so: runs of blanks of merge models, whose pieces have tied scores that the
        order of merges alone tells apart, and long words without others of their length."""
        ids = [np.concatenate([[self.score[m][1]] if m in self.score else self.spelled(m) for m in self.merged(w)]).astype(np.int32) if self.merges and w.startswith(SPACE * 2) else np.array(self.alone(w), np.int32) for w in words]
        return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words of one length, one after the other, and their counts; of equal scores, longer last pieces win."""
        if self.merges and SPACE * 2 in words[0][:2] or len(words[0]) >= ALONE and len(words) < FEW:
            return self.one_by_one(words)
        codes = _codes(words)
        n, size = codes.shape
        hashes = self.prefixes(codes)
        best = np.zeros((n, size + 1))
        step, piece = np.ones((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        for e in range(1, size + 1):
            top = np.full(n, -np.inf)
            for k in sorted(self.by_length, reverse=True):
                if k > e:
                    continue
                keys, ids, score = self.by_length[k]
                h = hashes[:, e] - hashes[:, e - k] * self.power[k]
                hit = np.flatnonzero(self.may[k][h & _LOW])
                at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                same = keys[at] == h[hit]
                hit, at = hit[same], at[same]
                if k == 1:
                    bare = np.ones(n, bool)
                    bare[hit] = False
                    bare = np.flatnonzero(bare)
                if self.merges:
                    ok = (top[hit] < 0) & ((self.rank[ids[at]] >= 0) | (k == 1))
                    hit, at = hit[ok], at[ok]
                    ok = self.stable(piece[hit, e - k], ids[at])
                    hit, at = hit[ok], at[ok]
                    s = np.zeros(len(hit))
                else:
                    s = best[hit, e - k] + score[at]
                better = s > top[hit]
                hit, at = hit[better], at[better]
                top[hit], step[hit, e], piece[hit, e] = s[better], k, ids[at]
                if k == 1 and len(bare):
                    s = np.zeros(len(bare)) if self.merges else best[bare, e - 1] + self.unknown
                    better = s > top[bare]
                    top[bare[better]], step[bare[better], e], piece[bare[better], e] = s[better], 1, -1
            best[:, e] = top
        found = np.full((n, size), -2, np.int32)
        where = np.full((n, size), 0, np.int32)
        pos, rows, k = np.full(n, size), np.arange(n), 0
        while len(rows):
            at = pos[rows]
            found[rows, size - 1 - k], where[rows, size - 1 - k] = piece[rows, at], at - 1
            pos[rows] = at - step[rows, at]
            rows, k = rows[pos[rows] > 0], k + 1
        used = found != -2
        flat, count = found[used], used.sum(1)
        if (flat < 0).any():
            r, p = np.nonzero(used)
            bare = np.flatnonzero(flat < 0)
            places = where[r[bare], p[bare]]
            spelled = [self.spelled(chr(c)) for c in codes[r[bare], places].tolist()]
            size = np.ones(len(flat), np.int64)
            size[bare] = [len(x) for x in spelled]
            out = np.repeat(flat, size)
            out[np.repeat(flat < 0, size)] = np.concatenate(spelled)
            flat, count = out, np.add.reduceat(size, np.cumsum(count) - count)
        return flat.astype(np.int32), count

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of distinct words in the store, to which new ones are added."""
        got = np.array([self.known.get(w, -1) for w in words], np.int64)
        if len(self.known) + int((got < 0).sum()) > KNOWN or len(self.pool) > KEPT:
            self.clear()
            got[:] = -1
        new = np.flatnonzero(got < 0)
        size = np.array([-len(w) if w.startswith(SPACE * 2) else len(w) for w in words[new]], np.int64)
        order = new[np.argsort(size, kind="stable")]
        size = np.sort(size)
        flat, counts = [self.pool], [self.count]
        for n in np.unique(size):
            own = order[np.searchsorted(size, n) : np.searchsorted(size, n, "right")]
            most = max(1, 2_000_000 // abs(int(n)))
            for x in range(0, len(own), most):
                ids, count = self.viterbi(words[own[x : x + most]].tolist())
                flat.append(ids)
                counts.append(count)
        got[order] = len(self.count) + np.arange(len(order))
        self.known.update(zip(words[order].tolist(), got[order].tolist(), strict=True))
        self.pool, self.count = np.concatenate(flat), np.concatenate(counts)
        self.begin = np.cumsum(self.count) - self.count
        return got

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; an empty text has none."""
        for a, b in slices(texts, 4_000_000):
            split = [_WORD.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts[a:b]]
            split = [[p for w in s for p in (self.cut(w) if len(w) > LONG else (w,))] if max(map(len, s), default=0) > LONG else s for s in split]
            number, words = pd.factorize(np.array([w for s in split for w in s], object))
            own = self.numbers(words)[number]
            begin, count = self.begin[own], self.count[own]
            flat = self.pool[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            ends = np.r_[0, np.cumsum(count)][np.cumsum([0, *map(len, split)])].tolist()
            for x, y in zip(ends, ends[1:], strict=False):
                yield flat[x:y]

    def texts_of(self, ids: list[np.ndarray]) -> pa.Array:
        """The texts of arrays of ids, as decode has them, in one gather of the pieces' bytes."""
        size = np.array([len(b) for b in self.bytes], np.int64)
        begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(self.bytes), np.uint8)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        n = size[flat]
        out = data[np.repeat(begin[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.r_[0, np.cumsum(n)][np.cumsum([0, *map(len, ids)])]
        first = np.minimum(ends[:-1], max(len(out) - 1, 0))
        blank = (ends[1:] > ends[:-1]) & (out[first] == 32) if len(out) else np.zeros(len(ids), bool)
        keep = np.ones(len(out), bool)
        keep[ends[:-1][blank]] = False  # the dummy prefix
        ends = ends - np.r_[0, np.cumsum(blank)]
        raw = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[keep].tobytes())])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, without the dummy prefix."""
        text = b"".join([self.bytes[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model of a path, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """docs with ids (array<int>) and decoded (what they decode to), replaced where docs has such columns.

    A null text counts as empty and has no ids; repeated rows have theirs each; an empty table gives no rows. Every text is
    encoded whole; text without blanks is cut where no piece crosses, and takes about the time of other text. Decoding gives the text back, but for the
    blank symbol U+2581 itself, which becomes a blank, and for lone surrogates. path must be readable on all executors.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        for b in parts:
            texts = [t or "" for t in b[text].to_pylist()]
            for x, y in slices(texts, 4_000_000):
                ids = list(own.encode(texts[x:y]))
                new = [pa.array(ids, pa.list_(pa.int32())), own.texts_of(ids)]
                yield pa.RecordBatch.from_arrays([*b.slice(x, y - x).columns, *new], names=[*b.schema.names, "ids", "decoded"])

    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(run, docs.select("*", F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded")).schema)
