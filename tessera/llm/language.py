"""Language identification by the nearest of several clustered centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams (one to three letters, words padded by a blank).
Spherical k-means gives each language its centroids, fitted on a bounded sample of labelled rows; a text gets the
language of the centroid of largest cosine, and is rejected when that cosine is too small for its number of letters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Hash buckets; centroids of a language; labelled rows per language that the fit takes (about: by a hash of the row).
BUCKETS, CENTROIDS, SAMPLE = 4096, 4, 300
#: A text is rejected below this share of the cosine that 99 % of the sample reach, less for few letters.
SLACK, FEW_LETTERS = 0.5, 60
#: Most labels that a fit takes, and rows of all of them.
LABELS, ROWS = 2000, 20_000
_MUL = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233], np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the counts of its hashed n-grams, and its number of letters."""
    low = [t.lower() for t in texts]
    c = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(-1, len(low)), [1, *(len(t) + 1 for t in low)])
    letter = _letters()[c]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    c, of, letter = np.where(letter, c, np.uint32(32))[kept], of[kept], letter[kept]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    found = np.zeros(len(low) * BUCKETS)
    for grams, m in ((1, _MUL[:1]), (2, _MUL[1:3]), (3, _MUL[3:])):
        h = sum((c[k : len(c) - grams + 1 + k] * m[k] for k in range(1, grams)), c[: len(c) - grams + 1] * m[0])
        mine = of[grams - 1 :]
        ok = letter if grams == 1 else np.ones(len(h), bool) if grams == 2 else letter[1:-1]  # a blank never follows a blank
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> shift
        ok = ok & (mine >= 0)
        found += np.bincount(mine[ok] * BUCKETS + h[ok], minlength=len(found))
    return found.reshape(len(low), BUCKETS), np.bincount(of[letter], minlength=len(low))


@dataclass
class Model:
    """idf by bucket, centroids (rows), the language of each, and the least cosine of texts with many letters."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: float

    def vectors(self, found: np.ndarray) -> np.ndarray:
        v = (np.log1p(found) * self.idf).astype(np.float32)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language (und without letters or model), cosine from 0 to 1, and whether the text is rejected, of each."""
        texts = [t or "" for t in texts]
        for a, b in slices(texts, 250_000):
            for x in range(a, b, 64):
                found, letters = counts(texts[x : min(b, x + 64)])
                if not self.langs:
                    yield from (("und", 0.0, not n) for n in letters)
                    continue
                cosine = self.vectors(found) @ self.centroids.T
                best = cosine.argmax(1)
                for k, (n, j) in enumerate(zip(letters, best, strict=True)):
                    s = min(1.0, max(0.0, float(cosine[k, j])))
                    yield (self.langs[j], s, s < self.least * n / (n + FEW_LETTERS)) if n else ("und", 0.0, True)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the vectors that are least alike."""
    chosen = [int((v @ v.mean(0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        sums = np.stack([v[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text is a multiple of 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from text and lang of the rows that are not held out; at most about `sample` rows of each language, and ROWS of all,
    by a hash of id and text, a repeated row once. Without labelled rows the model knows no language. Of more labels than LABELS,
    which no column of languages has, those of most rows are learned."""
    own = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()}
    if not sizes:
        return Model(np.ones(BUCKETS), np.zeros((0, BUCKETS), np.float32), [], 0.0)
    sample = min(sample, max(1, ROWS // len(sizes)))
    rate = F.from_json(F.lit(json.dumps({lang: min(1.0, sample / n) for lang, n in sizes.items()})), "map<string,double>")
    digest = F.xxhash64("doc_id", "text", F.lit("sample"))
    chosen = own.where(F.pmod(digest, F.lit(1_000_003)) < rate[F.col("lang")] * 1_000_003)
    chosen = chosen.groupBy("lang", digest.alias("digest")).agg(F.any_value("text").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts, langs = b["text"].to_pylist(), b["lang"].to_pylist()
            for x in range(0, len(texts), 64):
                found, letters = counts(texts[x : x + 64])
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs[x : x + 64], pa.string()), "n": pa.array(letters, pa.int64()), "v": pa.array([f.astype(np.uint16).tobytes() for f in np.minimum(found, 65535)], pa.binary())})

    got = chosen.mapInArrow(run, "lang string, n long, v binary").where("n > 0").toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), got["n"].to_pylist(), got["v"].to_pylist(), strict=True))
    if not rows:
        return Model(np.ones(BUCKETS), np.zeros((0, BUCKETS), np.float32), [], 0.0)
    found = np.stack([np.frombuffer(v, np.uint16) for *_, v in rows]).astype(np.float32)
    model = Model(np.log((1 + len(rows)) / (1 + (found > 0).sum(0))) + 0.1, np.zeros((0, BUCKETS), np.float32), [], 0.0)
    v, langs, letters = model.vectors(found), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for lang in sorted(set(langs)):
        c = _clusters(v[langs == lang], k)
        model.centroids = np.concatenate([model.centroids, c.astype(np.float32)])
        model.langs += [str(lang)] * len(c)
    best = (v @ model.centroids.T).max(1) * (letters + FEW_LETTERS) / letters
    model.least = SLACK * float(np.quantile(best, 0.01))
    return model


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected (names after prefix; columns so named are replaced).

    A null text, and one without letters, is und, 0 and rejected. Ties go to the first centroid by language. Whole
    texts count; repeated rows get equal predictions; an empty table stays empty.
    """
    names = [prefix + n for n in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            made = list(model.predict(b["text"].to_pylist()))
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(False).alias(names[2])).schema
    return docs.mapInArrow(run, schema)
