import hashlib
import os

import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bytepairs
from tessera.llm.queries import op11_bytepairs

pytestmark = pytest.mark.skipif(not os.path.exists(bytepairs.RANKS), reason="no public ranks")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n \t x", "a" * 3000, "ab" * 5000, "thequickbrownfoxjumpsoverthelazydog" * 300, "日本語のテキスト" * 200, "I'll don't O'Neill's 'S",
    "tab\x1cfile\x85end wide᠎x", "\U0001f600\U0001fae8 ͸ new letters \U000323b0\U000323b1 12³ Ⅷ", "line\r\nline   \r\n", "<|endoftext|>", "é" * 70 + " " + "0123456789" * 9,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bytepairs.PATTERN, mergeable_ranks={p: k for k, p in enumerate(bytepairs.read(bytepairs.RANKS))}, special_tokens={})


def test_the_fixed_values_are_the_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    assert bytepairs.PATTERN == public.PATTERN
    assert os.path.samefile(bytepairs.RANKS, public.path("byte_bpe_multi_50k.tiktoken"))


def test_odd_texts_as_the_library_has_them_beside_columns_of_any_name(spark, library):
    rows = [(k, t, [7], f"w{k}") for k, t in enumerate(ODD + ODD[:4])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids array<int>, bytepairs_words string")
    got = bytepairs.decode(bytepairs.encode(docs)).orderBy("doc_id").collect()
    assert sorted(got[0].asDict()) == ["bytepairs_words", "decoded", "doc_id", "ids", "text"]
    for r, (_, t, _, w) in zip(got, rows, strict=True):
        assert r["ids"] == library.encode_ordinary(t or ""), t
        assert bytes(r["decoded"]).decode() == (t or "") and r["bytepairs_words"] == w


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert bytepairs.decode(bytepairs.encode(docs)).collect() == []
    assert bytes(bytepairs.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["decoded"]) == b""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_as_the_library(spark, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    assert {r["doc_id"]: tuple(r)[1:] for r in op11_bytepairs(spark, SF).collect()} == want


def test_fold_of_higher_order_functions_as_the_library(spark, library):
    words = ["", "a", " the", "unbelievably", "zzzzzzz", "naïveté", "日本語", " Donaudampfschiff"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bytepairs.folded(F.col("w").cast("binary")).alias("ids")).collect()
    own = bytepairs.load(bytepairs.RANKS)
    for r in got:  # one word, whatever the pattern would make of it
        want = [own.rank[r["w"].encode()]] if r["w"].encode() in own.rank else own.alone(r["w"].encode()).tolist()
        assert r["ids"] == want, r["w"]
        assert len(bytepairs.regex.findall(bytepairs.PATTERN, r["w"])) != 1 or want == library.encode_ordinary(r["w"])
