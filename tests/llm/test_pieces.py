import copy
import os

import numpy as np
import pytest
import sentencepiece

from tessera.llm import pieces
from tessera.llm.queries import op3_pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no public model")
SF = "/root/testdata/sf0.001"


def plain(own, score, names, text):
    """Viterbi over a whole text, a position at a time."""
    if not text:
        return []
    t = (pieces.SPACE + text).replace(" ", pieces.SPACE)
    best = [(0.0, 0, None)]
    for e in range(1, len(t) + 1):
        top = None
        for k in range(min(16, e), 0, -1):
            i = names.get(t[e - k : e])
            s = best[e - k][0] + score[i] if i is not None else best[e - 1][0] + own.unknown if k == 1 else None
            if s is not None and (top is None or s > top[0]):
                top = (s, k, i)
        best.append(top)
    out, e = [], len(t)
    while e:
        _, k, i = best[e]
        out.append([i] if i is not None else [int(own.byte_ids[b]) for b in t[e - 1].encode()])
        e -= k
    return [i for ids in reversed(out) for i in ids]


@pytest.fixture(scope="module")
def model():
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    n = m.get_piece_size()
    names = {m.id_to_piece(k): k for k in range(n) if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k))}
    return pieces.load(pieces.MODEL), [m.get_score(k) for k in range(n)], names


def random_texts():
    rng = np.random.default_rng(6)
    alphabet = list("etaoinshrd  \n.,'-_=") + ["é", "日", "😀", "ß", "\t", "the", "ing", "    ", "́"]
    return ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(300)] + ["", " ", "   ", "word " * 4000]


def test_unigram_against_plain_viterbi(model):
    own, score, names = model
    own = copy.copy(own)
    own.merges = False
    own.clear()
    texts = random_texts()
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain(own, score, names, t), t
        assert own.decode(ids.tolist()) == t


def test_merge_model_against_library(model):
    """The ids are those of the library, on real and on random texts."""
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    duckdb = pytest.importorskip("duckdb")
    real = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] if os.path.isdir(SF) else []
    texts = random_texts() + real + ["representation of unbelievable internationalisation", "aaaaaaaaaaaaaaaaaaaa", "==================", "x" * 3000]
    got = [x.tolist() for x in model[0].encode(texts)]
    for t, ids, want in zip(texts, got, lib.encode(texts), strict=True):
        assert ids == want, (t, ids, want)
        assert model[0].decode(ids) == t


def unspaced():
    rng = np.random.default_rng(9)
    base64 = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 20_000))
    chinese = "".join(rng.choice(list("的一是不了人我在有他这中大来上国日本語テスト"), 20_000))
    return [base64, chinese, "unbelievableinternationalisation" * 600, "x" * 20_000, "日本" * 300 + "word" * 200]


def test_text_without_blanks(model):
    """Long words against the library, and by the other search; twenty thousand letters take no seconds."""
    import time

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    begin = time.time()
    got = [x.tolist() for x in model[0].encode(unspaced())]
    assert time.time() - begin < 8
    for t, ids, want in zip(unspaced(), got, lib.encode(unspaced()), strict=True):
        assert ids == want
    own = copy.copy(model[0])
    own.merges = False
    own.clear()
    for t in unspaced():
        t = t[:3000]
        assert next(own.encode([t])).tolist() == plain(own, *model[1:], t)


def test_gathered_texts(model):
    own = model[0]
    texts = [*random_texts(), *unspaced()]
    ids = list(own.encode(texts)) + [np.array([200, 201], np.int32), np.zeros(0, np.int32), np.array([0, 5], np.int32)]
    assert own.texts_of(ids).to_pylist() == [own.decode(i.tolist()) for i in ids]
    assert own.texts_of([]).to_pylist() == []


def test_query_round_trip(spark, tmp_path):
    got = op3_pieces(spark, SF)
    assert got.where("not round_trip").count() == 0 and got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = [(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "long " * 60_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' ids").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.n_tokens for r in op3_pieces(spark, str(tmp_path)).collect())[:2] == [0, 0]
    assert pieces.encode(spark.createDataFrame([], "text string")).count() == 0
